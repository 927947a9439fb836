"""Sources and sinks: file formats and partitioned tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def scratch(spark: SparkSession) -> str:
    """A new folder for a query's files: below spark.checkpoint.dir where that is set, as executors share it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        import uuid

        return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-") + "/out"


def written(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """``df`` written in a format and read again with its own schema."""
    path = scratch(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to files that executors share, and read back; whatever uses it several times sees the same rows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(_NATION)
def parquet_files(t: Tables) -> DataFrame:
    """Parquet."""
    return written(t.nation, "parquet")


@query(_NATION)
def csv_files(t: Tables) -> DataFrame:
    """CSV with a header."""
    return written(t.nation, "csv", header="true")


@query(_NATION)
def json_files(t: Tables) -> DataFrame:
    """JSON lines."""
    return written(t.nation, "json")


@query(_NATION)
def orc_files(t: Tables) -> DataFrame:
    """ORC."""
    return written(t.nation, "orc")


@query(_NATION)
def xml_files(t: Tables) -> DataFrame:
    """XML, a row in each tag."""
    return written(t.nation, "xml", rowTag="nation")


@query("SELECT n_name AS value FROM nation")
def text_files(t: Tables) -> DataFrame:
    """Lines of text."""
    return written(t.nation.select(F.col("n_name").alias("value")), "text")


@query("SELECT CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer")
def binary_files(t: Tables) -> DataFrame:
    """Whole files as bytes."""
    path = scratch(t.spark)
    t.customer.select("c_name").write.text(path)
    return t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.sum(F.length("content")).alias("bytes"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def partitioned_table(t: Tables) -> DataFrame:
    """A table in folders by value, of which a filter reads one."""
    path = scratch(t.spark)
    t.orders.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
