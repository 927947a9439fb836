"""Event-time grouping in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling(t: Tables) -> DataFrame:
    """Windows of an hour."""
    w = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(_ntz("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * o AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS v(o) GROUP BY ALL""")
def sliding(t: Tables) -> DataFrame:
    """Windows of an hour, each half hour."""
    return t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(_ntz("w.start").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(t: Tables) -> DataFrame:
    """Sessions that end with half an hour of silence."""
    s = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", _ntz("w.start").alias("start"), "n")
