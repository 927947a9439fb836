"""Projections, filters, predicates, casts and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables, sql


@query("""SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem
WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '2000-01-01'""")
def filter_project(t: Tables) -> DataFrame:
    """A range filter that reaches the scan and a computed column."""
    rows = t.lineitem.where((F.col("l_quantity") > 45) & (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("net"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority LIKE '%H%'""")
def case_in_between_like(t: Tables) -> DataFrame:
    """CASE, IN, BETWEEN and LIKE."""
    rows = t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 400000) & F.col("o_orderpriority").like("%H%"))
    price = F.col("o_totalprice")
    return rows.select("o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"))


@query("""SELECT p_partkey, p_size / 7 AS ratio, CAST(p_size // 7 AS BIGINT) AS whole, CAST(p_size % 7 AS INTEGER) AS rest, CAST((-p_size) // 7 AS BIGINT) AS neg FROM part""")
def integer_arithmetic(t: Tables) -> DataFrame:
    """Division, integer division and remainder."""
    return t.part.selectExpr("p_partkey", "p_size / 7 as ratio", "p_size div 7 as whole", "p_size % 7 as rest", "(-p_size) div 7 as neg")


@query("""SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_mktsegment AS BIGINT) AS bad FROM customer""")
def safe_cast(t: Tables) -> DataFrame:
    """Casts that give null in place of an error."""
    return t.customer.selectExpr("c_custkey", "try_cast(substr(c_name, 10) as bigint) as number", "try_cast(c_mktsegment as bigint) as bad")


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, round(1000 / nullif(c_nationkey, 0), 4) AS per FROM customer""")
def guarded_division(t: Tables) -> DataFrame:
    """A division guarded by nullif, and a cast that truncates."""
    return t.customer.selectExpr("c_custkey", "cast(c_acctbal as bigint) as whole", "round(1000 / nullif(c_nationkey, 0), 4) as per")


_MONTHS = """WITH RECURSIVE months(m, last) AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE), CAST(max(o_orderdate) AS DATE) FROM {orders} WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT CAST(m + INTERVAL 1 MONTH AS DATE), last FROM months WHERE CAST(m + INTERVAL 1 MONTH AS DATE) <= last)
SELECT CAST(m AS DATE) AS m, count(o_orderkey) AS n FROM months LEFT JOIN (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS own FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) o ON own = m GROUP BY m"""


@query(_MONTHS.replace("{orders}", "orders"))
def recursive_cte(t: Tables) -> DataFrame:
    """A recursive common table expression: all months between a table's first and last, so that months without a row are counted too."""
    return sql(t.spark, t.sf_dir, _MONTHS, "orders")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL""")
def group_by_all(t: Tables) -> DataFrame:
    """GROUP BY ALL."""
    return sql(t.spark, t.sf_dir, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", "orders")


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderstatus""")
def pipe_syntax(t: Tables) -> DataFrame:
    """The pipe operator of SQL."""
    return sql(t.spark, t.sf_dir, "FROM {orders} |> WHERE o_totalprice > 200000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "orders")


@query("""SELECT p_partkey, x, y, coalesce(x, y, 0) AS first_known, greatest(x, y) AS most, nullif(x, 2) AS not_two, x IS NOT DISTINCT FROM y AS same, x = y AS equal
FROM (SELECT p_partkey, nullif(p_size % 4, 0) AS x, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS y FROM part)""")
def null_semantics(t: Tables) -> DataFrame:
    """Nulls in comparisons and functions."""
    rows = t.part.selectExpr("p_partkey", "nullif(p_size % 4, 0) as x", "case when p_size % 3 > 0 then p_size % 3 end as y")
    return rows.selectExpr("*", "coalesce(x, y, 0) as first_known", "greatest(x, y) as most", "nullif(x, 2) as not_two", "x <=> y as same", "x = y as equal")


@query("""SELECT c_custkey, band, low FROM customer JOIN (VALUES ('low', -1e9, 0.0), ('mid', 0.0, 5000.0), ('high', 5000.0, 1e9)) v(band, low, high) ON c_acctbal >= low AND c_acctbal < high""")
def inline_values(t: Tables) -> DataFrame:
    """Inline values as a table, joined to one."""
    return sql(t.spark, t.sf_dir, "SELECT c_custkey, band, low FROM {customer} JOIN (VALUES ('low', -1e9D, 0.0D), ('mid', 0.0D, 5000.0D), ('high', 5000.0D, 1e9D)) v(band, low, high) ON c_acctbal >= low AND c_acctbal < high", "customer")


@query("""SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def qualify(t: Tables) -> DataFrame:
    """QUALIFY as a window and a filter, which Spark prunes before its sort ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("r", F.row_number().over(w)).where("r = 1").select("p_partkey", "p_brand")


@query("""SELECT min(cut) AS cut FROM (SELECT CAST(1000 * 2 ** i AS BIGINT) AS cut FROM range(40) r(i)) WHERE 10 * (SELECT count(*) FROM orders WHERE o_totalprice > cut) <= (SELECT count(*) FROM orders)""")
def scripting(t: Tables) -> DataFrame:
    """A SQL script: a limit on prices is doubled until at most a tenth of the orders lie above it."""
    t.orders.createOrReplaceTempView("marlstone_script_orders")
    return t.spark.sql("""BEGIN
      DECLARE cut BIGINT = 1000; DECLARE above BIGINT; DECLARE total BIGINT;
      SET (total, above) = (SELECT count(*), count_if(o_totalprice > cut) FROM marlstone_script_orders);
      WHILE 10 * above > total DO
        SET cut = cut * 2;
        SET above = (SELECT count(*) FROM marlstone_script_orders WHERE o_totalprice > cut);
      END WHILE;
      SELECT cut AS cut;
    END""")


@query("""SELECT p_partkey FROM part WHERE p_name LIKE '%a!_b%' ESCAPE '!' OR p_name LIKE '%e%'""")
def like_escape(t: Tables) -> DataFrame:
    """LIKE with an escape character that both engines read alike."""
    return sql(t.spark, t.sf_dir, "SELECT p_partkey FROM {part} WHERE p_name LIKE '%a!_b%' ESCAPE '!' OR p_name LIKE '%e%'", "part")
