"""Structured Streaming over the event table, run to its end with an available-now trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import scratch


def stream(t: Tables) -> DataFrame:
    """The events as a stream; event time must be a timestamp with a zone."""
    schema = t.events.schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(t.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run(out: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream emits until its input ends, as a table of files.

    Batches are written under their number, so a batch that is run again replaces
    itself.
    """
    spark, path, log = out.sparkSession, scratch(out.sparkSession), scratch(out.sparkSession)
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    else:
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{n if mode == 'update' else 0}")
        q = out.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", mode != "append").parquet(path)


#: The last watermark of a run over all events, in SQL: what lies after it is still open, so twins leave it out.
_END = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
#: The same of streams of views and clicks, which wait for the slower one.
_BOTH = "(SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'click')) - INTERVAL 10 MINUTE FROM events)"
_PAIRS = """WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
j AS (SELECT v.event_id AS view_id, c.event_id AS click_id, v.ts AS t1, c.ts AS t2 FROM v FULL JOIN c ON v.user_id = c.user_id AND c.ts >= v.ts - INTERVAL 1 HOUR AND c.ts <= v.ts + INTERVAL 1 HOUR)"""


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'""")
def stream_filter(t: Tables) -> DataFrame:
    """Stateless projection into a file sink."""
    return run(stream(t).where("event_type = 'purchase'").select("event_id", "user_id", "value"))


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def stream_tumbling(t: Tables) -> DataFrame:
    """Hourly counts in complete mode, which equal the batch result."""
    out = stream(t).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run(out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query(f"""SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {_END}""")
def stream_watermark(t: Tables) -> DataFrame:
    """Hourly counts as windows close; the last stays open."""
    out = stream(t).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run(out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


@query(f"""SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) v(o))
GROUP BY start HAVING start + INTERVAL 1 HOUR <= {_END}""")
def stream_sliding(t: Tables) -> DataFrame:
    """Sliding windows as they close."""
    out = stream(t).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return run(out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


@query(f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_END}""")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions as they close."""
    out = stream(t).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return run(out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


@query("""SELECT DISTINCT user_id FROM events""")
def stream_distinct(t: Tables) -> DataFrame:
    """Each user once, with state that the watermark bounds."""
    return run(stream(t).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id"]).select("user_id"))


@query("""SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_stream_join(t: Tables) -> DataFrame:
    """Clicks and purchases within the hour, from two streams."""
    a = stream(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u1"), F.col("ts").alias("t1")).withWatermark("t1", "10 minutes")
    b = stream(t).where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("u2"), F.col("ts").alias("t2")).withWatermark("t2", "10 minutes")
    return run(a.join(b, F.expr("u1 = u2 and t2 > t1 and t2 <= t1 + interval 1 hour")).select("click_id", "buy_id"))


@query("""SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey""")
def stream_static_join(t: Tables) -> DataFrame:
    """A stream with a table."""
    return run(stream(t).join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def stream_memory(t: Tables) -> DataFrame:
    """A memory sink in complete mode."""
    name = f"m{uuid.uuid4().hex}"
    out = stream(t).groupBy("event_type").agg(F.count("*").alias("n"))
    out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name)


def _clicks_views(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = stream(t).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u1"), F.col("ts").alias("t1")).withWatermark("t1", "10 minutes")
    b = stream(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u2"), F.col("ts").alias("t2")).withWatermark("t2", "10 minutes")
    return a, b


NEAR = "u1 = u2 and t2 >= t1 - interval 1 hour and t2 <= t1 + interval 1 hour"


@query(f"""{_PAIRS} SELECT view_id, click_id FROM j WHERE view_id IS NOT NULL AND (click_id IS NOT NULL OR t1 + INTERVAL 1 HOUR < {_BOTH})""")
def stream_left_join(t: Tables) -> DataFrame:
    """Views with clicks within the hour, or null once the watermark rules a click out."""
    a, b = _clicks_views(t)
    return run(a.join(b, F.expr(NEAR), "left").select("view_id", "click_id"))


@query(f"""{_PAIRS} SELECT view_id, click_id FROM j WHERE view_id IS NOT NULL AND click_id IS NOT NULL OR coalesce(t1, t2) + INTERVAL 1 HOUR < {_BOTH}""")
def stream_full_join(t: Tables) -> DataFrame:
    """The same from both sides."""
    a, b = _clicks_views(t)
    return run(a.join(b, F.expr(NEAR), "full").select("view_id", "click_id"))


@query("""SELECT event_id AS view_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click'
AND b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts + INTERVAL 1 HOUR)""")
def stream_semi_join(t: Tables) -> DataFrame:
    """Views that have a click within the hour."""
    a, b = _clicks_views(t)
    return run(a.join(b, F.expr(NEAR), "left_semi").select("view_id"))


@query(f"""{_PAIRS} SELECT view_id FROM j WHERE click_id IS NULL AND t1 + INTERVAL 1 HOUR < {_BOTH}""")
def stream_anti_join(t: Tables) -> DataFrame:
    """Views that have none: an outer join and a filter, as streams have no anti join."""
    a, b = _clicks_views(t)
    return run(a.join(b, F.expr(NEAR), "left").where("click_id is null").select("view_id"))


@query(f"""SELECT date_trunc('day', start) AS start, max(n) AS most FROM (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1)
GROUP BY 1 HAVING date_trunc('day', min(start)) + INTERVAL 1 DAY <= {_END}""")
def stream_chained(t: Tables) -> DataFrame:
    """Windows of windows: hourly counts, then the busiest hour of each day."""
    hours = stream(t).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    days = hours.groupBy(F.window("w", "1 day").alias("d")).agg(F.max("n").alias("most"))
    return run(days.select(F.col("d.start").cast("timestamp_ntz").alias("start"), "most"))


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY user_id""")
def stream_state(t: Tables) -> DataFrame:
    """Counts held in a stateful processor of our own, on a RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Counter(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "n long")

        def handleInputRows(self, key, rows, timers):
            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(x) for x in rows)
            self.seen.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self) -> None:
            pass

    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, store)
    try:
        counted = stream(t).select("user_id").groupBy("user_id").transformWithStateInPandas(Counter(), "user_id long, n long", "Update", "None")
        return run(counted, "update").groupBy("user_id").agg(F.max("n").alias("n"))
    finally:
        t.spark.conf.set(name, before)


@query("""SELECT event_id FROM events""")
def stream_batches(t: Tables) -> DataFrame:
    """A sink of our own by foreachBatch."""
    return run(stream(t).select("event_id"), "update")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def stream_sorted(t: Tables) -> DataFrame:
    """A sort, which streams allow in complete mode after an aggregate."""
    return run(stream(t).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type"), "complete")


@query("""SELECT least(count(*), 100) AS n, least(count(*), 100) AS known FROM events""")
def stream_limit(t: Tables) -> DataFrame:
    """A limit on a stream: rows in all, and those that are events, each once; which ones they are is open."""
    got = run(stream(t).select("event_id").limit(100))
    known = t.events.select("event_id").join(got.select("event_id"), "event_id", "left_semi").agg(F.count("*").alias("known"))
    return got.agg(F.count("*").alias("n")).crossJoin(known)  # one row each


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_drop_duplicates(t: Tables) -> DataFrame:
    """Each pair once, with state that grows with the number of pairs."""
    return run(stream(t).select("user_id", "event_type").dropDuplicates())
