"""Joins: kinds, strategies, as-of and range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables, sql
from marlstone.sources.files import kept

#: A side that has at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a key, of both sides, that an as-of join keeps in one span.
SPAN_ROWS = 1_000_000
#: Pairs of a key that one task of a join of few keys makes.
TASK_PAIRS = 1_000_000
#: The greatest double, and the least length of a range that levels tell apart.
MOST, LEAST = 1.7976931348623157e308, 2.0**-1000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def right_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The right outer join by one key, whose pairs are dealt evenly to tasks if keys are few and crowded.

    The rows of ``right`` are cut into as many shares as the most crowded key asks for, and
    each share meets all of ``left``. So a task's pairs are bounded; all pairs are still made.
    """
    count = lambda df, key, name: df.groupBy(F.col(f"`{key}`").alias("_k")).agg(F.count("*").alias(name))
    made = count(left, left_key, "_a").join(count(right, right_key, "_b"), "_k").select((F.col("_a").cast("double") * F.col("_b")).alias("_p"))
    most, total = made.agg(F.max("_p"), F.sum("_p")).first()
    shares = math.ceil((most or 0) / TASK_PAIRS)
    if shares < 2:
        return left.join(right, F.col(f"`{left_key}`") == F.col(f"`{right_key}`"), "right")
    n, ls, rs = math.ceil(total / TASK_PAIRS), fresh_name("_left_share", left, right), fresh_name("_right_share", left, right)
    lhs = left.withColumn(ls, F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(n, left_key, ls)
    rhs = right.withColumn(rs, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in right.columns]), F.lit(shares)).cast("int")).repartition(n, right_key, rs)
    return lhs.join(rhs, (F.col(f"`{left_key}`") == F.col(f"`{right_key}`")) & (F.col(ls) == F.col(rs)), "right").drop(ls, rs)


def fresh_name(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no table has it."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_of(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, values: list[str], bucket: float | None = None, tie: list[str] | None = None) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before it, by key ``on``; null if there is none.

    One shuffle of the union and a running window, so a key's work is linear in
    its rows. Right rows come first at equal times; of right rows at one time the
    greatest by ``tie`` counts (by ``values``, if none are given), nulls least. A
    null key or time matches nothing, as in SQL: such right rows are left out, and
    such left rows are dealt to tasks at random and get null. A hot key is cut into spans of
    time, which become tasks of their own, and only the last right row of each span is
    carried to the next. ``bucket`` is the length of a span in seconds (or units, for
    numbers), of all keys; without it, keys of over `SPAN_ROWS` rows are found by a
    count, and each is cut into equal spans of about so many. Rows of one key that share one time
    stay in one task. ``float("inf")`` saves the count where no key is hot.
    """
    kind, number = F.struct(*[F.col(v).alias(f"_v_{v}") for v in values]), lambda c: F.col(c).cast("timestamp").cast("double") if "timestamp" in right.schema[right_ts].dataType.simpleString() else F.col(c).cast("double")
    lost = F.col("_k").isNull() | F.col("_t").isNull()
    lhs = left.select(F.col(on).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    rhs = right.select(F.col(on).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), kind.alias("_r"), F.struct(*(tie or values)).alias("_tie")).where(~lost)
    widths = None
    if bucket is None:
        times = lhs.select("_k", "_t").where(~lost).union(rhs.select("_k", "_t")).groupBy("_k").agg(F.count("*").alias("_n"), F.min(number("_t")).alias("_from"), F.max(number("_t")).alias("_to"))
        widths = times.where((F.col("_n") > SPAN_ROWS) & (F.col("_from") < F.col("_to"))).select(F.col("_k").alias("_hot"), ((F.col("_to") - F.col("_from")) / F.ceil(F.col("_n") / SPAN_ROWS)).alias("_width"))
        hot = widths.limit(BROADCAST_ROWS + 1).count()
        widths = (F.broadcast(widths) if hot <= BROADCAST_ROWS else widths) if hot else None

    def cut(side: DataFrame) -> DataFrame:
        if widths is None:
            return side.withColumn("_span", F.lit(0).cast("long") if bucket is None else F.floor(number("_t") / bucket))
        side = side.join(widths, F.col("_k") == F.col("_hot"), "left")
        return side.withColumn("_span", F.coalesce(F.floor(number("_t") / F.col("_width")), F.lit(0))).drop("_hot", "_width")

    lhs, rhs = cut(lhs), cut(rhs)
    lhs = lhs.withColumn("_span", F.when(lost, F.monotonically_increasing_id() % 4096).otherwise(F.col("_span"))).withColumn("_k", F.when(~lost, F.col("_k")))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    w = Window.partitionBy("_k", "_span").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last_value("_r", F.lit(True)).over(w)).where("_side = 1")
    if bucket is not None or widths is not None:
        ends = rhs.groupBy("_k", "_span").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_r"))
        asked = both.select("_k", "_span").distinct().withColumn("_r", F.lit(None).cast(ends.schema["_r"].dataType))
        before = Window.partitionBy("_k").orderBy("_span").rangeBetween(Window.unboundedPreceding, -1)
        carried = ends.unionByName(asked).withColumn("_c", F.last_value("_r", F.lit(True)).over(before)).groupBy("_k", "_span").agg(F.max("_c").alias("_c"))
        carried = carried.select(F.col("_k").alias("_ck"), F.col("_span").alias("_cs"), "_c")
        both = both.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_span") == F.col("_cs")), "left").withColumn("_last", F.coalesce("_last", "_c"))
    return both.select("_l.*", *[F.col(f"_last._v_{v}").alias(f"{v}_as_of") for v in values])


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order; times as seconds."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(f"`{name}`")
    return c.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Pairs with low <= point < high, and equal columns ``on`` if given, by an equi-join on cells of doubling widths.

    A range lives at the level whose cells are the first as wide as itself, and meets two
    of them, or by rounding three; a point is copied once to each level that ranges live
    at. So neither long ranges among short ones nor the other way round make many rows. The
    number of levels is at most that of the exponents of a double, and in practice that
    of the doublings between the shortest and the longest range. Ranges are first cut to
    the extent of the points, so an endless one is no wider than that. Ranges that hold
    nothing, and nulls, match nothing. ``width`` is the least width of a cell; shorter
    ranges share a level then.
    """
    on = on or []
    pc, rc = fresh_name("_cell", points, ranges), fresh_name("_level", points, ranges)
    x = _number(points, point)
    first, last = points.agg(F.min(x), F.max(x)).first()
    if first is None or math.isnan(last):  # NaN lies in no range, so the extent is that of the numbers
        first, last = points.where(~F.isnan(x)).agg(F.min(x), F.max(x)).first()
    first, last = (0.0, 0.0) if first is None else (max(first, -MOST), min(last, MOST))
    a, b = F.greatest(_number(ranges, low), F.lit(first)), F.least(_number(ranges, high), F.lit(last))
    real = (F.col(f"`{low}`") < F.col(f"`{high}`")) & (a <= b)
    length = F.greatest(b / 2 - a / 2, F.lit((width or 0.0) / 2), F.lit(LEAST))  # half, as the whole may be no double
    level = F.ceil(F.log2(length)).cast("int") + 1
    cell = lambda v, at: F.floor(v / F.pow(F.lit(2.0), at))
    cells = F.explode(F.sequence(cell(a, F.col(f"`{rc}`")), cell(b, F.col(f"`{rc}`"))))
    spread = ranges.where(real).withColumn(rc, level)
    levels = sorted(r[0] for r in spread.select(rc).distinct().collect())
    spread = spread.withColumn(pc, cells)
    if not levels:
        levels = [0]
    own = points.where(~F.isnan(x)).withColumn(rc, F.explode(F.array(*[F.lit(i) for i in levels]))).withColumn(pc, cell(x, F.col(f"`{rc}`")))
    return own.join(spread, [rc, pc, *on]).where((F.col(f"`{point}`") >= F.col(f"`{low}`")) & (F.col(f"`{point}`") < F.col(f"`{high}`"))).drop(rc, pc)


def range_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, value: str, by: list[str]) -> DataFrame:
    """(``by``, n, total): over the pairs with low <= point < high, by columns of ``ranges``, their number and the sum of ``value``, a whole number; groups without pairs are left out.

    No pair is formed: what lies in a range is what comes before its end less what comes
    before its beginning. Points and ends of ranges are dealt by order into spans, each
    span is summed up as it is read, and the spans before it are added. So the work is that
    of a sort, however many points a range holds. Nulls, and ranges that hold nothing,
    match nothing; the total is null if all values are.
    """
    at = points.where(F.col(f"`{point}`").isNotNull()).select(F.col(f"`{point}`").alias("_at"), F.col(f"`{value}`").cast("decimal(20, 0)").alias("_v"))
    at = at.groupBy("_at").agg(F.count("*").alias("_n"), F.count("_v").alias("_m"), F.sum("_v").alias("_v")).withColumn("_side", F.lit(1))
    real = ranges.where(F.col(f"`{low}`") < F.col(f"`{high}`"))
    ends = F.explode(F.array(F.struct(F.col(f"`{low}`").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col(f"`{high}`").alias("at"), F.lit(1).alias("sign"))))
    asks = real.select(F.struct(*[F.col(f"`{c}`") for c in by]).alias("_by"), ends.alias("_e")).select("_by", F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_sign"), F.lit(0).alias("_side"))
    both = at.unionByName(asks, allowMissingColumns=True)
    # files hold the spans, as numbers of tasks must not change between the two readings
    spans = kept(both.repartitionByRange("_at", "_side").withColumn("_span", F.spark_partition_id()))
    sums, zero = ("_n", "_m", "_v"), F.lit(0).cast("decimal(38, 0)")
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    whole = spans.groupBy("_span").agg(*[F.sum(c).cast("decimal(38, 0)").alias(c) for c in sums])
    whole = whole.select("_span", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_before") for c in sums])
    within = Window.partitionBy("_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    run = spans.select("*", *[F.coalesce(F.sum(c).over(within).cast("decimal(38, 0)"), zero).alias(f"{c}_run") for c in sums]).where("_side = 0")
    run = run.join(F.broadcast(whole), "_span").select("_by", *[((F.col(f"{c}_run") + F.col(f"{c}_before")) * F.col("_sign")).cast("decimal(38, 0)").alias(c) for c in sums])
    out = run.groupBy("_by").agg(*[F.sum(c).alias(c) for c in sums]).where("_n > 0")
    return out.select("_by.*", F.col("_n").cast("long").alias("n"), F.when(F.col("_m") > 0, F.col("_v").cast("long")).alias("total"))


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Pairs of ranges that share a point, and equal columns ``on`` if given.

    Either the right one begins within the left one, or the left one begins within the
    right one and after its beginning; both are range joins, and no pair comes twice.
    Ranges are half open; those that hold nothing overlap nothing.
    """
    held = lambda df, r: df.where(F.col(f"`{r[0]}`") < F.col(f"`{r[1]}`"))
    a, b = held(left, left_range), held(right, right_range)
    begins = range_join(b, a, right_range[0], *left_range, on=on)
    within = range_join(a, b, left_range[0], *right_range, on=on).where(F.col(f"`{left_range[0]}`") > F.col(f"`{right_range[0]}`"))
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*(on or []), *left.columns, *right.columns])]
    return begins.select(*columns).unionAll(within.select(*columns))


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_inner(t: Tables) -> DataFrame:
    """Inner equi-join."""
    c = t.customer.where("c_mktsegment = 'BUILDING'")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey""")
def join_left(t: Tables) -> DataFrame:
    """Left outer join."""
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_nationkey = c_nationkey""")
def join_right(t: Tables) -> DataFrame:
    """Right outer join."""
    c = t.customer.where("c_acctbal > 9000")
    return right_join(t.supplier.where("s_acctbal > 5000"), c, "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM (SELECT * FROM part WHERE p_size < 10) a FULL JOIN (SELECT * FROM part WHERE p_size BETWEEN 5 AND 15) b ON a.p_partkey = b.p_partkey""")
def join_full(t: Tables) -> DataFrame:
    """Full outer join."""
    a, b = t.part.where("p_size < 10").alias("a"), t.part.where("p_size between 5 and 15").alias("b")
    return a.join(b, F.col("a.p_partkey") == F.col("b.p_partkey"), "full").select(F.col("a.p_partkey").alias("a_key"), F.col("b.p_partkey").alias("b_key"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def join_semi(t: Tables) -> DataFrame:
    """Left semi join."""
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def join_anti(t: Tables) -> DataFrame:
    """Left anti join."""
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""")
def join_not_in(t: Tables) -> DataFrame:
    """NOT IN, a null-aware anti join."""
    return sql(t.spark, t.sf_dir, "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000)", "customer", "supplier")


@query("""SELECT r_name, n_name FROM region CROSS JOIN nation""")
def join_cross(t: Tables) -> DataFrame:
    """Cross join of two tables of fixed size."""
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("""SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def join_interval(t: Tables) -> DataFrame:
    """Equal users, and a purchase within the hour."""
    a, b = t.events.where("event_type = 'click'").alias("a"), t.events.where("event_type = 'purchase'").alias("b")
    soon = F.expr("b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & soon).select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("buy_id"))


@query("""SELECT p_partkey, low FROM part JOIN (SELECT 900 + 50 * CAST(i AS INTEGER) AS low FROM range(0, 24) r(i)) b ON p_retailprice >= low AND p_retailprice < low + 75""")
def join_range(t: Tables) -> DataFrame:
    """Values within overlapping ranges, without a nested loop."""
    bands = t.spark.range(0, 24).selectExpr("cast(900 + 50 * id as int) as low", "cast(975 + 50 * id as int) as high")
    return range_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "low")


@query("""SELECT e.event_id, count(*) AS n, CAST(sum(p.event_id) AS BIGINT) AS ids FROM (SELECT event_id, ts, ts + to_minutes(CAST(floor(value * value) AS BIGINT)) AS till FROM events WHERE event_type = 'error') e
JOIN (SELECT event_id, ts FROM events WHERE event_type = 'purchase') p ON p.ts >= e.ts AND p.ts < e.till GROUP BY e.event_id""")
def join_range_levels(t: Tables) -> DataFrame:
    """Purchases while an error lasts, with errors of a minute to days."""
    errors = t.events.where("event_type = 'error'").selectExpr("event_id", "ts AS since", "ts + make_dt_interval(0, 0, cast(floor(value * value) AS int), 0) AS till")
    buys = t.events.where("event_type = 'purchase'").selectExpr("event_id AS buy_id", "ts AS at")
    return range_totals(buys, errors, "at", "since", "till", "buy_id", ["event_id"]).withColumnRenamed("total", "ids")


_PERIODS = "SELECT o_custkey, o_orderkey, o_orderdate, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"""WITH p AS ({_PERIODS}) SELECT a.o_custkey, a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM p a JOIN p b ON a.o_custkey = b.o_custkey
AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.shipped AND b.o_orderdate < a.shipped AND a.o_orderdate < a.shipped AND b.o_orderdate < b.shipped""")
def join_overlaps(t: Tables) -> DataFrame:
    """Orders of one customer that were open at the same time."""
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    p = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").join(shipped, "o_orderkey")
    a = p.select("o_custkey", F.col("o_orderkey").alias("a_key"), F.col("o_orderdate").alias("a_from"), F.col("shipped").alias("a_to"))
    b = p.select("o_custkey", F.col("o_orderkey").alias("b_key"), F.col("o_orderdate").alias("b_from"), F.col("shipped").alias("b_to"))
    return overlap_join(a, b, ("a_from", "a_to"), ("b_from", "b_to"), on=["o_custkey"]).where("a_key < b_key").select("o_custkey", "a_key", "b_key")


@query("""SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_as_of(t: Tables) -> DataFrame:
    """Each click with the user's last view."""
    views = t.events.where("event_type = 'view'").withColumnRenamed("event_id", "view")
    out = as_of(t.events.where("event_type = 'click'"), views, "user_id", "ts", "ts", ["view"])
    return out.select("event_id", F.col("view_as_of").alias("view_id"))


@query("""SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_as_of_split(t: Tables) -> DataFrame:
    """The same with each user's time cut into days."""
    views = t.events.where("event_type = 'view'").withColumnRenamed("event_id", "view")
    out = as_of(t.events.where("event_type = 'click'"), views, "user_id", "ts", "ts", ["view"], bucket=86400)
    return out.select("event_id", F.col("view_as_of").alias("view_id"))


@query("""WITH e AS (SELECT event_id, nullif(user_id % 50, 7) AS k, CASE WHEN event_id % 11 > 0 THEN ts END AS at, event_type, value FROM events)
SELECT a.event_id, b.event_id AS last FROM (SELECT * FROM e WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.k = b.k AND a.at >= b.at""")
def join_as_of_nulls(t: Tables) -> DataFrame:
    """Null keys and times match nothing."""
    e = t.events.selectExpr("event_id", "nullif(user_id % 50, 7) as k", "case when event_id % 11 > 0 then ts end as at", "event_type")
    views = e.where("event_type = 'view'").withColumnRenamed("event_id", "last")
    return as_of(e.where("event_type = 'click'"), views, "k", "at", "at", ["last"], bucket=86400).select("event_id", F.col("last_as_of").alias("last"))


@query("""SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def join_lateral(t: Tables) -> DataFrame:
    """The dearest order of each customer, nulls last.

    The lateral table selects the price that it is ordered by: without it the engine numbers
    a customer's rows as a shuffle happens to bring them, after a sort that binds nothing.
    """
    return sql(t.spark, t.sf_dir, "SELECT c_custkey, o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1)", "customer", "orders")


@query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_broadcast(t: Tables) -> DataFrame:
    """A dimension whose size is checked before it is broadcast."""
    return t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def join_sort_merge(t: Tables) -> DataFrame:
    """A join of two large tables by sort and merge."""
    j = t.lineitem.hint("merge").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("""SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY p_brand""")
def join_shuffle_hash(t: Tables) -> DataFrame:
    """A join that builds a hash table for each partition of the smaller side."""
    p = t.part.where("p_size > 40").hint("shuffle_hash")
    return t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def local_supplier_revenue(t: Tables) -> DataFrame:
    """Six tables: revenue within a region from suppliers of the customer's nation."""
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    orders = t.orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return own.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(t: Tables) -> DataFrame:
    """Three tables, aggregate, top ten."""
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    o = t.orders.where(F.col("o_orderdate") < day).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate")
    j = t.lineitem.where(F.col("l_shipdate") > day).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""")
def correlated_subquery(t: Tables) -> DataFrame:
    """A correlated scalar subquery, which becomes an aggregate and a join."""
    return sql(t.spark, t.sf_dir, "SELECT count(*) AS n FROM {lineitem} l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)", "lineitem")


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def join_theta(t: Tables) -> DataFrame:
    """An equality and an inequality."""
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT event_id, b_id FROM (SELECT a.event_id, b.event_id AS b_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC) AS r FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 DAY WHERE a.event_type = 'click' AND b.event_type = 'view') WHERE r = 1""")
def join_as_of_within(t: Tables) -> DataFrame:
    """The last view of the day before each click: the as-of join with a bound."""
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("b_id"))
    out = as_of(t.events.where("event_type = 'click'"), views, "user_id", "ts", "seen", ["b_id", "seen"])
    return out.where(F.expr("seen_as_of >= ts - interval 1 day")).select("event_id", F.col("b_id_as_of").alias("b_id"))
