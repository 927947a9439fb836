"""State of our own on streams: sessions by timers, expiring state, windows over sorted rows, exact distinct counts, and state read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import scratch
from marlstone.streaming.events import run, stream

#: How late a row may be, and the silence that ends a session, in milliseconds.
LATE_MS, GAP_MS = 600_000, 1_800_000
#: A processor is called for up to so many users of consecutive ids at once, as each call and each read of state has its price.
USERS = 64


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors of our own need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _users(part: pd.DataFrame) -> list[int | None]:
    """The users of a frame's rows; those without an id are a group of their own."""
    return [None] * len(part) if part["user_id"].isna().all() else part["user_id"].tolist()


class Sessions(StatefulProcessor):
    """Rows of a group of users in sessions: a user's rows closer than a gap belong together; a session is given out once the watermark is a gap past its last row.

    Open sessions are one value of state, arrays in order of user and time, so that rows may come in any
    order and join two of them; a group is read and written once, however many sessions it has. One timer, kept
    with them, waits for the first that can end.
    """

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "user array<long>, first array<long>, last array<long>, n array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans, timer = self._held()
        for part in rows:
            spans += [(user, ms, ms, 1) for user, ms in zip(_users(part), part["ms"].tolist(), strict=True)]
        self._keep(spans, timer)
        return iter(())

    def _held(self) -> tuple[list[tuple], int | None]:
        held = self.open.get() if self.open.exists() else None
        return ([], None) if held is None else (list(zip(*held[:4], strict=True)), held[4])

    def _keep(self, spans: list[tuple], timer: int | None) -> None:
        joined: list[list] = []
        for user, first, last, n in sorted(spans):
            if joined and user == joined[-1][0] and first < joined[-1][2] + self.gap:
                joined[-1] = [user, joined[-1][1], max(joined[-1][2], last), joined[-1][3] + n]
            else:
                joined.append([user, first, last, n])
        due = min(s[2] for s in joined) + self.gap if joined else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if joined:
            self.open.update((*map(list, zip(*joined, strict=True)), due))
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spans, _ = self._held()
        done = [s for s in spans if s[2] + self.gap <= now]
        self._keep([s for s in spans if s[2] + self.gap > now], None)  # the timer that has expired is gone
        if done:
            yield pd.DataFrame({"user_id": pd.array([s[0] for s in done], "Int64"), "first_ms": [s[1] for s in done], "n": [s[3] for s in done]})

    def close(self) -> None:
        pass


class Sorted(StatefulProcessor):
    """Rows of a group of users in order of time, once the watermark rules out earlier ones, each with its number, the time since the user's one before, and the running sum.

    Rows wait in a list; what has been given out is summed up in one value a user. So analytic windows
    over all rows before, which streams don't have, hold no more rows than are still open.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "user long, ms long, id long, value double")
        self.given = handle.getMapState("given", "user long", "n long, ms long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(_users(part), part["ms"].tolist(), part["event_id"].tolist(), part["value"].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wait(min(r[1] for r in new))
        return iter(())

    def _wait(self, ms: int) -> None:
        held = list(self.handle.listTimers())
        if not held or ms < min(held):
            for other in held:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[1] <= now], [r for r in rows if r[1] > now]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[1] for r in rest))
        given = {k[0]: tuple(v) for k, v in self.given.iterator()} if ready else {}
        out, changed = [], set()
        for user, ms, event_id, value in ready:
            n, before, total = given.get(user, (0, None, 0.0))
            given[user] = (n + 1, ms, total + value)
            out.append((event_id, n + 1, None if before is None else ms - before, total + value))
            changed.add(user)
        for user in changed:
            self.given.updateValue((user,), given[user])
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "nth", "since", "total"])
            yield frame.astype({"since": "Int64"})

    def close(self) -> None:
        pass


class Newcomers(StatefulProcessor):
    """The first row of each kind for each of a group of users, with state that expires a day after it was written."""

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "user long, kind string", "n long", 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = {tuple(k) for k in self.seen.keys()}  # noqa: SIM118
        kinds = dict.fromkeys(r for part in rows for r in zip(_users(part), part["event_type"].tolist(), strict=True))
        fresh = [r for r in kinds if r not in seen]
        for r in fresh:
            self.seen.updateValue(r, (1,))
        if fresh:
            yield pd.DataFrame({"user_id": pd.array([r[0] for r in fresh], "Int64"), "event_type": [r[1] for r in fresh]})

    def close(self) -> None:
        pass


class Totals(StatefulProcessor):
    """A key's count and greatest value, one value of state."""

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", "n long, most double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, most = self.sums.get() if self.sums.exists() else (0, float("-inf"))
        for part in rows:
            n, most = n + len(part), max(most, float(part["value"].max()))
        self.sums.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame):
    """``rows`` by groups of up to USERS users; their number grows with that of the users, so a group's state doesn't."""
    return rows.withColumn("users", F.shiftright("user_id", USERS.bit_length() - 1)).groupBy("users")


def _timed(t: Tables) -> DataFrame:
    return stream(t).withWatermark("ts", f"{LATE_MS} milliseconds").withColumn("ms", F.unix_millis("ts"))


#: The watermark at the end of the input, in SQL: whole milliseconds before the last row.
_END = "(SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events)"


@query(f"""SELECT user_id, first_ms, n FROM (SELECT user_id, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session)
WHERE last_ms + 1800000 <= {_END}""")
def stream_timer_sessions(t: Tables) -> DataFrame:
    """Sessions that a processor of our own ends by event-time timers; the twin leaves out those that are open at the end."""
    with rocksdb(t.spark):
        out = _grouped(_timed(t).select("user_id", "ts", "ms")).transformWithStateInPandas(Sessions(), "user_id long, first_ms long, n long", "Append", "EventTime")
        return run(out)


@query(f"""SELECT event_id, nth, since, round(total, 6) AS total FROM (SELECT event_id, ts, row_number() OVER w AS nth, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS since, sum(value) OVER w AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS UNBOUNDED PRECEDING)) WHERE (epoch_us(ts) // 1000) <= {_END}""")
def stream_analytic(t: Tables) -> DataFrame:
    """Row number, lag and running sum of each user's events on a stream, from a buffer that the watermark empties in order."""
    with rocksdb(t.spark):
        rows = _timed(t).select("user_id", "ts", "ms", "event_id", "value")
        out = _grouped(rows).transformWithStateInPandas(Sorted(), "event_id long, nth long, since long, total double", "Append", "EventTime")
        return run(out).withColumn("total", F.round("total", 6))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_expiring_state(t: Tables) -> DataFrame:
    """The first event of each kind of each user, from state with a time to live."""
    with rocksdb(t.spark):
        out = _grouped(stream(t).select("user_id", "event_type")).transformWithStateInPandas(Newcomers(), "user_id long, event_type string", "Append", "ProcessingTime")
        path = scratch(t.spark)
        # processing time never ends, so an available-now run would go on for ever; one batch reads all files
        q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(t.spark)).trigger(once=True).start()
        q.awaitTermination()
        return t.spark.read.schema(out.schema).parquet(path)


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_state_read_back(t: Tables) -> DataFrame:
    """The state of a finished stream, read from its checkpoint as a table."""
    log = scratch(t.spark)
    with rocksdb(t.spark):
        out = stream(t).select("user_id", "value").groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long", "Update", "None")
        q = out.writeStream.outputMode("update").option("checkpointLocation", log).format("noop").trigger(availableNow=True).start()
        q.awaitTermination()
        state = t.spark.read.format("statestore").option("stateVarName", "sums").load(log)
        return state.select("key.user_id", "value.n", "value.most")


@query("""SELECT date_trunc('hour', ts) AS start, count(DISTINCT user_id) AS users FROM events GROUP BY 1
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_count_distinct(t: Tables) -> DataFrame:
    """Exact distinct users by hour, which streams don't have as an aggregate: one row for each user and hour, then a count of those."""
    once = stream(t).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    hours = once.groupBy(F.window("w", "1 hour").alias("h")).agg(F.count("*").alias("users"))
    return run(hours.select(F.col("h.start").cast("timestamp_ntz").alias("start"), "users"))
