"""Sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine's results assume."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set what may be set on a running session: a fixed time zone and adaptive plans."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


_SCHEMAS: dict[tuple[str, str, int], StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. Its schema is read from the files once in an application and again when they have changed, as that takes a job."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, path, changed)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


class Tables:
    """Tables of a folder by attribute: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a table of ``sf_dir``; no temporary view is left behind."""
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})
