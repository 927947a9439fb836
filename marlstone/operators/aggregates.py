"""Aggregates: sums, distinct counts, quantiles, moments, sketches, grouping sets, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.selection import percentiles
from marlstone.plans.registry import query
from marlstone.session import Tables, sql


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t: Tables) -> DataFrame:
    """The pricing summary: one scan, two keys, partial aggregates before the shuffle."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"),
        F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(t: Tables) -> DataFrame:
    """A global sum under range filters that reach the scan."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = t.lineitem.where((F.col("l_shipdate") >= at("1997-01-01")) & (F.col("l_shipdate") < at("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT c_mktsegment, count(*) AS n, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_mktsegment""")
def basic_aggregates(t: Tables) -> DataFrame:
    """count, min, max and a sum of integers."""
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high"), F.sum("c_custkey").alias("keys"))


@query("""SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total FROM orders GROUP BY o_orderpriority""")
def decimal_sum(t: Tables) -> DataFrame:
    """An exact sum of decimals."""
    return t.orders.groupBy("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type""")
def count_distinct(t: Tables) -> DataFrame:
    """Two distinct counts in one pass."""
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def exact_percentiles(t: Tables) -> DataFrame:
    """Interpolated percentiles, without a task that holds a group's values."""
    out = percentiles(t.events, ["event_type"], "value", {"median": 0.5, "p90": 0.9})
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query("""SELECT round(quantile_disc(value, 0.5), 6) AS median FROM events""")
def approximate_percentile(t: Tables) -> DataFrame:
    """percentile_approx at an accuracy that makes it exact here."""
    return t.events.agg(F.round(F.percentile_approx("value", 0.5, 1_000_000), 6).alias("median"))


@query("""SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 4) AS var, round(corr(value, user_id), 6) AS r, round(covar_samp(value, user_id), 3) AS cov FROM events GROUP BY event_type""")
def moments(t: Tables) -> DataFrame:
    """Standard deviation, variance, correlation and covariance."""
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"), F.round(F.corr("value", "user_id"), 6).alias("r"), F.round(F.covar_samp("value", "user_id"), 3).alias("cov"))


@query("""SELECT round(n * s4 / (s2 * s2) - 3, 4) AS kurtosis, round(sqrt(n) * s3 / power(s2, 1.5), 4) AS skewness FROM (
SELECT count(*) AS n, sum(power(value - m, 2)) AS s2, sum(power(value - m, 3)) AS s3, sum(power(value - m, 4)) AS s4 FROM events, (SELECT avg(value) AS m FROM events))""")
def shape(t: Tables) -> DataFrame:
    """Kurtosis and skewness of a population."""
    return t.events.agg(F.round(F.kurtosis("value"), 4).alias("kurtosis"), F.round(F.skewness("value"), 4).alias("skewness"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS base, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def regression(t: Tables) -> DataFrame:
    """A line fitted by least squares."""
    return t.lineitem.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("base"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 100""")
def filtered_having(t: Tables) -> DataFrame:
    """FILTER and HAVING."""
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n")).where("n > 100")


@query("""SELECT l_returnflag, bool_and(l_quantity > 0) AS all_some, bool_or(l_discount > 0.09) AS any_big, bit_xor(l_orderkey) AS mix FROM lineitem GROUP BY l_returnflag""")
def bool_bit_aggregates(t: Tables) -> DataFrame:
    """bool_and, bool_or and bit_xor."""
    return t.lineitem.groupBy("l_returnflag").agg(F.bool_and(F.col("l_quantity") > 0).alias("all_some"), F.bool_or(F.col("l_discount") > 0.09).alias("any_big"), F.bit_xor("l_orderkey").alias("mix"))


@query("""SELECT c_mktsegment, arg_max(c_custkey, struct_pack(b := c_acctbal, k := c_custkey)) AS richest FROM customer GROUP BY c_mktsegment""")
def arg_max(t: Tables) -> DataFrame:
    """max_by with a tie-break."""
    return t.customer.groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"))


@query("""SELECT n_regionkey, list_sort(list(n_name)) AS names, array_to_string(list_sort(list(n_name)), ',') AS line FROM nation GROUP BY n_regionkey""")
def collected(t: Tables) -> DataFrame:
    """collect_list and listagg of groups of fixed size."""
    return sql(t.spark, t.sf_dir, "SELECT n_regionkey, array_sort(collect_list(n_name)) AS names, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS line FROM {nation} GROUP BY n_regionkey", "nation")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""")
def grouping_sets(t: Tables) -> DataFrame:
    """GROUPING SETS."""
    return sql(t.spark, t.sf_dir, "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS int) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", "lineitem")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup(t: Tables) -> DataFrame:
    """ROLLUP."""
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def cube(t: Tables) -> DataFrame:
    """CUBE over three keys."""
    return t.lineitem.cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority""")
def pivot(t: Tables) -> DataFrame:
    """PIVOT with named values, which saves the pass that would look for them."""
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT c_custkey, name, val FROM (SELECT c_custkey, c_acctbal AS bal, CAST(c_nationkey AS DOUBLE) AS nat FROM customer) UNPIVOT (val FOR name IN (bal, nat))""")
def unpivot(t: Tables) -> DataFrame:
    """Columns to rows."""
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nat")).unpivot("c_custkey", ["bal", "nat"], "name", "val")


@query("""SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0""")
def empty_input(t: Tables) -> DataFrame:
    """Aggregates of no rows."""
    return t.orders.where("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("""SELECT o_orderstatus, min(o_orderpriority) AS usual FROM (SELECT o_orderstatus, o_orderpriority, rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) AS r
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)) WHERE r = 1 GROUP BY o_orderstatus""")
def most_frequent(t: Tables) -> DataFrame:
    """mode; of equally frequent values the least."""
    return sql(t.spark, t.sf_dir, "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS usual FROM {orders} GROUP BY o_orderstatus", "orders")


@query()
def sketches(t: Tables) -> DataFrame:
    """Mergeable sketches: distinct users by HyperLogLog, a quantile by KLL; approximate, so without an exact twin."""
    return sql(t.spark, t.sf_dir, """SELECT event_type, approx_count_distinct(user_id) AS users, hll_sketch_estimate(hll_sketch_agg(user_id)) AS users_hll,
      kll_sketch_get_quantile_double(kll_sketch_agg_double(value), 0.5) AS median,
      size(histogram_numeric(value, 8)) AS bars, length(count_min_sketch(user_id, 0.01d, 0.95d, 1)) AS count_min_bytes FROM {events} GROUP BY event_type""", "events")
