"""Table functions over table arguments, partitioned and ordered by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marlstone.plans.registry import query
from marlstone.session import Tables


def _checked(rows: AnalyzeArgument, name: AnalyzeArgument) -> StructType:
    """The fields of a table argument that has a column of a constant name."""
    if not rows.isTable:
        raise ValueError("the first argument is TABLE(...)")
    if not name.isConstantExpression or name.value not in rows.dataType.names:
        raise ValueError(f"the second argument names a column of the table: {', '.join(rows.dataType.names)}")
    return rows.dataType


@udtf
class Sessionise:
    """Each row of a table with the number of its session within its partition: a silence of so many minutes begins a new one.

    ``sessionise(TABLE(t) PARTITION BY k ORDER BY (at, id), 'at', 30)``. It holds the last
    time alone, so a partition may have any number of rows. A null time is in the session of the
    row before.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, at: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=StructType([*_checked(rows, at).fields, StructField("session", LongType())]))

    def __init__(self):
        self.last, self.session = None, 0

    def eval(self, rows, at: str, minutes: int):
        now = rows[at]
        if self.session == 0 or (now is not None and self.last is not None and (now - self.last).total_seconds() >= 60 * minutes):
            self.session += 1
        self.last = now if now is not None else self.last
        yield (*rows, self.session)


@udtf
class Decayed:
    """Each row of a table with an average of its partition's values so far, in which a value's weight halves with each row after it.

    ``decayed(TABLE(t) PARTITION BY k ORDER BY (at, id), 'value')``. Null values change nothing.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=StructType([*_checked(rows, value).fields, StructField("decayed", DoubleType())]))

    def __init__(self):
        self.mean = None

    def eval(self, rows, value: str):
        v = rows[value]
        if v is not None:
            self.mean = v if self.mean is None else (self.mean + v) / 2
        yield (*rows, self.mean)


@query("""SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)""")
def table_function_sessions(t: Tables) -> DataFrame:
    """Events numbered by session, by a table function over events partitioned by user and ordered by time."""
    t.spark.udtf.register("sessionise", Sessionise)
    t.events.select("event_id", "user_id", "ts").createOrReplaceTempView("events_to_sessionise")
    return t.spark.sql("SELECT event_id, user_id, session FROM sessionise(TABLE(events_to_sessionise) PARTITION BY user_id ORDER BY (ts, event_id), 'ts', 30)")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
d AS (SELECT user_id, event_id, k, value AS decayed FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, (d.decayed + o.value) / 2 FROM d JOIN o ON o.user_id = d.user_id AND o.k = d.k + 1)
SELECT event_id, decayed FROM d""")
def table_function_decayed(t: Tables) -> DataFrame:
    """A fading average of each user's values, which no window function gives."""
    t.spark.udtf.register("decayed", Decayed)
    t.events.select("event_id", "user_id", "ts", "value").createOrReplaceTempView("events_to_average")
    return t.spark.sql("SELECT event_id, decayed FROM decayed(TABLE(events_to_average) PARTITION BY user_id ORDER BY (ts, event_id), 'value')")
