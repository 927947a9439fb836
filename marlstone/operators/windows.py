"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables, sql


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt,
round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def ranks(t: Tables) -> DataFrame:
    """All ranking functions over one sort."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    long = lambda f, name: f.over(w).cast("long").alias(name)
    return t.orders.select("o_orderkey", long(F.row_number(), "rn"), long(F.rank(), "rk"), long(F.dense_rank(), "dr"), long(F.ntile(4), "nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def offsets(t: Tables) -> DataFrame:
    """lag, lead, first_value and nth_value."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first_value("event_type").over(w).alias("first_type"), F.nth_value("event_id", 2).over(w).alias("second"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events""")
def ignore_nulls(t: Tables) -> DataFrame:
    """The last value that isn't null."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last_value(F.when(F.col("event_type") == "view", F.col("event_id")), F.lit(True)).over(w).alias("last_view"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS near FROM events""")
def rows_frame(t: Tables) -> DataFrame:
    """A moving average over rows."""
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-2, 2)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 6).alias("near"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def interval_frame(t: Tables) -> DataFrame:
    """A count over the last day."""
    return sql(t.spark, t.sf_dir, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM {events}", "events")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 2) AS running FROM orders""")
def peers(t: Tables) -> DataFrame:
    """The default frame, in which peers count together."""
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")), 2).alias("running"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_per_group(t: Tables) -> DataFrame:
    """The three dearest orders of each customer; cut before the shuffle by a group limit."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders""")
def groups_frame(t: Tables) -> DataFrame:
    """A GROUPS frame, as a RANGE frame over the dense rank."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    ranked = t.orders.withColumn("g", F.dense_rank().over(w))
    return ranked.select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 0)).alias("n"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS others, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), 0), 4) AS around FROM events""")
def exclude_current(t: Tables) -> DataFrame:
    """EXCLUDE CURRENT ROW: the frame's count less one; the frames before and after, added."""
    users = Window.partitionBy("user_id")
    w = users.orderBy("ts")
    before, after = (F.coalesce(F.sum("value").over(w.rowsBetween(a, b)), F.lit(0.0)) for a, b in ((-3, -1), (1, 3)))
    return t.events.select("event_id", (F.count("*").over(users) - 1).alias("others"), F.round(before + after, 4).alias("around"))


@query("""SELECT event_id, (SELECT count(DISTINCT e.event_type) FROM events e WHERE e.user_id = events.user_id) AS kinds FROM events""")
def distinct_over(t: Tables) -> DataFrame:
    """A distinct count over a window, whose sets hold at most the five types."""
    return t.events.select("event_id", F.size(F.collect_set("event_type").over(Window.partitionBy("user_id"))).cast("long").alias("kinds"))
