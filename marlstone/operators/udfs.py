"""User-defined functions: scalar, aggregate, table, grouped and partition maps, SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.joins import small
from marlstone.plans.registry import query
from marlstone.session import Tables

#: Rows that a frame of a group holds on average, at most.
FRAME = 100_000


def shares(rows: Column) -> Column:
    """Into how many frames a group of so many rows is dealt."""
    return F.ceil(rows / FRAME).cast("long")


@query("""SELECT p_partkey, round(p_retailprice * 1.2, 2) AS gross FROM part""")
def pandas_scalar(t: Tables) -> DataFrame:
    """A function of whole batches."""

    @F.pandas_udf("double")
    def gross(x: pd.Series) -> pd.Series:
        return x * 1.2

    return t.part.select("p_partkey", F.round(gross("p_retailprice"), 2).alias("gross"))


@query("""SELECT n_nationkey, reverse(n_name) AS back FROM nation""")
def arrow_scalar(t: Tables) -> DataFrame:
    """A row function whose batches travel in Arrow."""
    back = F.udf(lambda s: None if s is None else s[::-1], "string", useArrow=True)
    return t.nation.select("n_nationkey", back("n_name").alias("back"))


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment""")
def pandas_aggregate(t: Tables) -> DataFrame:
    """An aggregate in two steps: each batch gives sums by key, which Spark adds up, so no task holds a group."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_key = pa.Table.from_batches([batch]).group_by("c_mktsegment").aggregate([("c_acctbal", "sum"), ("c_acctbal", "count")])
            yield from by_key.select(["c_mktsegment", "c_acctbal_sum", "c_acctbal_count"]).rename_columns(["c_mktsegment", "total", "n"]).to_batches()

    parts = t.customer.select("c_mktsegment", "c_acctbal").mapInArrow(sums, "c_mktsegment string, total double, n long")
    return parts.groupBy("c_mktsegment").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("mean"))


@query("""SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation""")
def table_function(t: Tables) -> DataFrame:
    """A table function, joined laterally."""

    @F.udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            for word in (text or "").split(" "):
                yield (word,)

    t.spark.udtf.register("marlstone_words", Words)
    return t.spark.sql("SELECT n_nationkey, word FROM {n}, LATERAL marlstone_words(n_name)", n=t.nation)


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS off FROM customer""")
def grouped_map(t: Tables) -> DataFrame:
    """Shares of groups as frames: a group's mean is an aggregate that is joined back, and a group of many rows is dealt to several frames."""

    def centred(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(off=(g["c_acctbal"] - g["mean"]).round(4))[["c_nationkey", "c_custkey", "off"]]

    rows = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    known = rows.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), shares(F.count("*")).alias("_n"))
    dealt = rows.join(small(known), "c_nationkey").withColumn("_share", F.pmod(F.xxhash64("c_custkey"), "_n"))
    return dealt.groupBy("c_nationkey", "_share").applyInPandas(centred, "c_nationkey int, c_custkey long, off double")


@query("""SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation
WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def cogrouped_map(t: Tables) -> DataFrame:
    """Two groups of a key as frames, share by share; what the shares give is added up."""

    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a, b = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    known = a.select("nation").union(b.select("nation")).groupBy("nation").agg(shares(F.count("*")).alias("_n"))
    a, b = (x.join(small(known), "nation").select("nation", F.pmod(F.xxhash64("id"), "_n").alias("_share")).groupBy("nation", "_share") for x in (a, b))
    parts = a.cogroup(b).applyInPandas(both, "nation int, customers long, suppliers long")
    return parts.groupBy("nation").agg(F.sum("customers").alias("customers"), F.sum("suppliers").alias("suppliers"))


@query("""SELECT p_partkey, upper(p_brand) AS brand FROM part WHERE p_size > 25""")
def partition_map(t: Tables) -> DataFrame:
    """Partitions as streams of Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["p_partkey"], pc.utf8_upper(batch["p_brand"])], names=["p_partkey", "brand"])

    return t.part.where("p_size > 25").select("p_partkey", "p_brand").mapInArrow(work, "p_partkey long, brand string")


@query("""SELECT c_custkey, round(c_acctbal * 2 + 1, 2) AS y FROM customer""")
def sql_function(t: Tables) -> DataFrame:
    """A function written in SQL, which the optimizer inlines."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION marlstone_line(x DOUBLE) RETURNS DOUBLE RETURN x * 2 + 1")
    return t.customer.select("c_custkey", F.expr("round(marlstone_line(c_acctbal), 2) as y"))
