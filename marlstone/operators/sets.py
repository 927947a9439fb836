"""Sorting, limits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables, sql


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5""")
def top_k(t: Tables) -> DataFrame:
    """Order, offset and limit, which keep k rows in each task."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


_NULLS = "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY x ASC NULLS LAST, c_custkey) AS INTEGER) AS up, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY x DESC NULLS FIRST, c_custkey) AS INTEGER) AS down FROM (SELECT c_custkey, c_nationkey, nullif(c_custkey % 7, 3) AS x FROM {customer})"


@query(_NULLS.replace("{customer}", "customer"))
def null_order(t: Tables) -> DataFrame:
    """Nulls placed explicitly."""
    return sql(t.spark, t.sf_dir, _NULLS, "customer")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY x ASC NULLS FIRST, c_custkey) AS INTEGER) AS r, isnan(x) AS odd
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS x FROM customer)""")
def nan_order(t: Tables) -> DataFrame:
    """NaN after all numbers, nulls before."""
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_first("x"), "c_custkey"))
    return t.customer.select("c_custkey", "c_nationkey", x.alias("x")).select("c_custkey", place.alias("r"), F.when(F.col("x").isNotNull(), F.isnan("x")).alias("odd"))


@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
def union_all(t: Tables) -> DataFrame:
    """UNION ALL."""
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(t: Tables) -> DataFrame:
    """UNION."""
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier""")
def intersect_all(t: Tables) -> DataFrame:
    """INTERSECT ALL."""
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("""SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""")
def except_all(t: Tables) -> DataFrame:
    """EXCEPT ALL."""
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("""SELECT p_partkey AS k FROM part WHERE p_size < 30 INTERSECT SELECT p_partkey FROM part WHERE p_retailprice > 950""")
def intersect_distinct(t: Tables) -> DataFrame:
    """INTERSECT."""
    return t.part.where("p_size < 30").select(F.col("p_partkey").alias("k")).intersect(t.part.where("p_retailprice > 950").select("p_partkey"))


@query("""SELECT p_partkey AS k FROM part WHERE p_size < 30 EXCEPT SELECT p_partkey FROM part WHERE p_retailprice > 950""")
def except_distinct(t: Tables) -> DataFrame:
    """EXCEPT."""
    return t.part.where("p_size < 30").select(F.col("p_partkey").alias("k")).subtract(t.part.where("p_retailprice > 950").select("p_partkey"))


@query("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def distinct_rows(t: Tables) -> DataFrame:
    """DISTINCT."""
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text""")
def exact_duplicates(t: Tables) -> DataFrame:
    """Equal texts, grouped by a digest, so that texts aren't shuffled."""
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query()
def sampled(t: Tables) -> DataFrame:
    """A tenth of the rows at random; the sample differs from engine to engine."""
    return t.lineitem.sample(fraction=0.1, seed=1)


@query()
def table_sample(t: Tables) -> DataFrame:
    """TABLESAMPLE, repeatable on the same files."""
    from marlstone.session import sql

    return sql(t.spark, t.sf_dir, "SELECT * FROM {orders} TABLESAMPLE (10 PERCENT) REPEATABLE (1)", "orders")


@query("""SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def union_by_name(t: Tables) -> DataFrame:
    """UNION ALL by column names."""
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))
