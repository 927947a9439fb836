"""What the corpus operators share: words, staged tables, shipping of the package, small guards."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as Java regular expressions write it: a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows without an id come after all others.
NO_ID = 2**63 - 1
#: A table of so many rows at most may be broadcast.
SMALL_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset; then a new temporary folder is taken.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, compressed by ``codec`` or as the session says.

    This cuts the lineage, keeps the rows through the loss of an executor, and
    computes them once however often they are used.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def ready(spark: SparkSession) -> None:
    """Make Python workers able to import this package, and keep Arrow batches small.

    Documents may be long, so a batch is bounded by bytes and by rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    top = Path(__file__).resolve().parents[2]
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(top) in on_path or getattr(spark.sparkContext, "_marlstone_shipped", False):
        return
    package = os.path.join(tempfile.mkdtemp(prefix="spark-"), "marlstone.zip")
    with zipfile.ZipFile(package, "w") as z:
        for f in sorted((top / "marlstone").rglob("*.py")):
            z.write(f, f.relative_to(top))
    spark.sparkContext.addPyFile(package)
    spark.sparkContext._marlstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; only Spark reads the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns of a row; maps by their text, as they have no order."""
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes]
    return F.xxhash64(F.lit(seed), *[x for c in plain for x in (c.isNull(), c)])


def repeated(counted: DataFrame, n: str, copy: str, chunk: int = 4096) -> DataFrame:
    """Each row of ``counted`` as often as its column ``n`` says, numbered from 1 in a new column ``copy``.

    Numbers are made in chunks that are dealt to all tasks, so a row of very many
    copies neither fills an array nor keeps one task busy.
    """
    (part,) = fresh(counted, "copy_part")
    parts = counted.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))))
    if not counted.where(F.col(n) > chunk).isEmpty():
        parts = parts.repartition(*counted.columns, part)
    first = F.col(part) * chunk
    return parts.withColumn(copy, F.explode(F.sequence(first + 1, F.least(first + chunk, F.col(n))))).drop(part)


def numbered(df: DataFrame, order: Column, number: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of a column, by ranges of it whose sizes are counted; no task sees all rows."""
    part, size, before = fresh(df, "range_part", "range_rows", "range_before")
    ranged = staged(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(part).agg(F.count("*").alias(size))
    upto = F.sum(size).over(Window.orderBy(part)) - F.col(size)  # one row for each partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranged.withColumn(number, own).join(F.broadcast(sizes.select(part, upto.alias(before))), part).withColumn(number, (F.col(number) + F.col(before)).cast("long")).drop(part, before)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
