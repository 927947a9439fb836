"""Versioned tables: MERGE as copy-on-write over Parquet files, published by manifests.

A table is a folder. ``data`` holds Parquet files that are never changed once they are
published; ``versions/N.json`` lists the files of version N with the range of the
leading key in each. A merge finds the files that hold a key of its source by a semi
join on the keys alone, rewrites those and no others, and publishes the next version.
Two merges that start from one version can't both publish: the second raises, and what
it wrote stays unseen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import kept, scratch

#: Rows that a file of a table, and a task of a merge, has on average at most.
FILE_ROWS = 250_000


def tasks(rows: int) -> int:
    """The number of tasks that so many rows are dealt to."""
    return max(-(-rows // FILE_ROWS), 1)


class MergeConflict(RuntimeError):
    """Another merge has published the version first."""


class DuplicateMatch(ValueError):
    """More than one source row matches a row of the table."""


@dataclass(frozen=True)
class Clause:
    """One WHEN clause: which rows it is for, its further condition, and the values that it sets (None: the row goes)."""

    kind: str
    when: str
    values: dict[str, str] | None


@dataclass
class Merge:
    """A MERGE statement. Expressions are SQL; ``t`` is the table, ``s`` the source. Of the clauses of a kind the first whose condition holds applies."""

    table: VersionedTable
    source: DataFrame
    clauses: list[Clause] = field(default_factory=list)

    def _add(self, kind: str, when: str | None, values: dict[str, str] | None) -> Merge:
        self.clauses.append(Clause(kind, when or "true", values))
        return self

    def update(self, values: dict[str, str], when: str | None = None) -> Merge:
        """WHEN MATCHED THEN UPDATE SET; columns that aren't named stay."""
        return self._add("matched", when, values)

    def delete(self, when: str | None = None) -> Merge:
        """WHEN MATCHED THEN DELETE."""
        return self._add("matched", when, None)

    def insert(self, values: dict[str, str] | None = None, when: str | None = None) -> Merge:
        """WHEN NOT MATCHED THEN INSERT; without values the source's columns of the same names; columns that aren't named are null."""
        names = self.table.schema.names
        return self._add("unmatched", when, {c: f"s.`{c}`" for c in names} if values is None else values)

    def update_unmatched(self, values: dict[str, str], when: str | None = None) -> Merge:
        """WHEN NOT MATCHED BY SOURCE THEN UPDATE SET."""
        return self._add("by_source", when, values)

    def delete_unmatched(self, when: str | None = None) -> Merge:
        """WHEN NOT MATCHED BY SOURCE THEN DELETE."""
        return self._add("by_source", when, None)

    def run(self) -> VersionedTable:
        """Publish the merged table as its next version."""
        return self.table._merge(self.source, self.clauses)


class VersionedTable:
    """A table in a folder; ``keys`` are the columns by which merges match."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._paths, self._conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._files = self._paths(self.path).getFileSystem(self._conf)
        self._read(self.version())

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], files: int | None = None) -> VersionedTable:
        """Write ``df`` as version 0, in about ``files`` files by ranges of the keys, or more, so that none has far over FILE_ROWS rows."""
        spark = df.sparkSession
        out = cls.__new__(cls)
        out.spark, out.path, out.keys, out.schema = spark, path.rstrip("/"), keys, df.schema
        out._paths, out._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        out._files = out._paths(out.path).getFileSystem(out._conf)
        least = tasks(df.count())
        out._publish(0, out._write(df, max(files or 1, least) if files or least > 1 else None))
        return cls(spark, path)

    # --- versions -----------------------------------------------------------------

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._paths(f"{self.path}/versions")
        return sorted(int(f.getPath().getName()[:10]) for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The newest version."""
        return self.versions()[-1]

    def _read(self, version: int) -> None:
        stream = self._files.open(self._paths(self._name(version)))
        try:
            spec = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.at, self.keys, self.files = version, spec["keys"], spec["files"]
        self.schema = StructType.fromJson(spec["schema"])

    def _publish(self, version: int, files: list[dict]) -> None:
        """Make a version visible at once: it is written aside and renamed, which fails where the name is taken."""
        text = json.dumps({"keys": self.keys, "schema": self.schema.jsonValue(), "files": files})
        aside, name = self._paths(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._paths(self._name(version))
        stream = self._files.create(aside, False)
        stream.write(text.encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self._conf)
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, name, options)
        except Exception as e:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise MergeConflict(f"version {version} of {self.path} is there already") from e
            raise

    # --- files --------------------------------------------------------------------

    def _write(self, df: DataFrame, files: int | None) -> list[dict]:
        """Write rows by ranges of the keys into a folder of their own, and list its files with their ranges of the leading key."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        ranged = df.repartitionByRange(*([files] if files else []), *self.keys)
        ranged.write.parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder)
        key = F.col(f"`{self.keys[0]}`")
        plain = written.schema[self.keys[0]].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "string")
        low, high = (F.min(key), F.max(key)) if plain else (F.lit(None), F.lit(None))
        if written.isEmpty():
            return []
        found = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(low.alias("low"), high.alias("high"), F.count("*").alias("rows"))
        return sorted(({"path": r["path"], "low": r["low"], "high": r["high"], "rows": r["rows"], "ranged": plain} for r in found.collect()), key=lambda f: f["path"])

    def _of(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f["path"] for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless given."""
        if version is None:
            return self._of(self.files)
        out = VersionedTable.__new__(VersionedTable)
        out.__dict__.update(self.__dict__)
        out._read(version)
        return out._of(out.files)

    # --- merging ------------------------------------------------------------------

    def merge(self, source: DataFrame) -> Merge:
        """A MERGE of ``source``, which has the key columns, into the newest version."""
        return Merge(self, source)

    def _overlapping(self, source: DataFrame) -> list[dict]:
        """Files whose range of the leading key meets that of the source."""
        if not any(f["ranged"] for f in self.files):
            return self.files
        low, high = source.agg(F.min(f"`{self.keys[0]}`"), F.max(f"`{self.keys[0]}`")).first()
        if low is None:
            return []
        return [f for f in self.files if not f["ranged"] or (f["low"] is not None and f["low"] <= high and f["high"] >= low)]

    def _merge(self, source: DataFrame, clauses: list[Clause]) -> VersionedTable:
        """See Merge.

        A null key matches nothing. A source row may match many rows of the table; a
        row of the table that two source rows match raises DuplicateMatch. The list of
        files is the driver's, as are their ranges; rows never are.
        """
        self._read(self.version())
        source = kept(source)  # read more than once, and must not change in between
        of = lambda kind: [c for c in clauses if c.kind == kind]
        keys = [F.col(f"`{k}`") for k in self.keys]
        near = self._overlapping(source)
        touched = set()
        if near:
            n = tasks(sum(f["rows"] for f in near) + source.count())
            held = self._of(near).select(*keys, F.col("_metadata.file_path").alias("_file")).repartition(n, *keys)
            hit = held.join(source.select(*keys).repartition(n, *keys).distinct(), self.keys, "left_semi").select("_file").distinct()
            touched = {r["_file"] for r in hit.collect()}
        if of("by_source"):
            touched = {f["path"] for f in self.files}
        mine = [f for f in self.files if f["path"] in touched]
        on = reduce(Column.__and__, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in self.keys])
        total = sum(f["rows"] for f in mine) + source.count()
        rows, source = self._of(mine).repartition(tasks(total), *keys), source.repartition(tasks(total), *keys)  # a task's rows are bounded, whatever the table's size
        self._refuse_duplicates(rows, source)
        given = source.withColumn("_given", F.lit(True)).alias("s")
        both = rows.alias("t").join(given, on, "left").withColumn("_matched", F.coalesce(F.col("s._given"), F.lit(False)))
        stay = both.withColumn("_clause", self._chosen(of("matched"), F.col("_matched")) + self._chosen(of("by_source"), ~F.col("_matched"), len(of("matched"))))
        changes = [*of("matched"), *of("by_source")]
        gone = [i + 1 for i, c in enumerate(changes) if c.values is None]
        stay = stay.where(~F.col("_clause").isin(gone)) if gone else stay
        result = stay.select(*[self._value(name, changes) for name in self.schema.names])
        if inserts := of("unmatched"):
            new = given.join(rows.select(*keys).distinct().alias("t"), on, "left_anti").withColumn("_clause", self._chosen(inserts, F.lit(True)))
            new = new.where("_clause > 0")
            result = result.unionByName(new.select(*[self._value(name, inserts, inserted=True) for name in self.schema.names]))
        written = self._write(result, max(len(mine), tasks(total)))
        self._publish(self.at + 1, [f for f in self.files if f["path"] not in touched] + written)
        return VersionedTable(self.spark, self.path)

    def _refuse_duplicates(self, rows: DataFrame, source: DataFrame) -> None:
        keys = [F.col(f"`{k}`") for k in self.keys]
        twice = source.groupBy(*keys).count().where("count > 1")
        bad = twice.join(rows.select(*keys), self.keys, "left_semi").select(*keys).limit(1).collect()
        if bad:
            raise DuplicateMatch(f"several source rows match {bad[0].asDict()}")

    @staticmethod
    def _chosen(clauses: list[Clause], where: Column, before: int = 0) -> Column:
        """The number of the first clause that applies, counted from ``before`` + 1; 0 if none does."""
        out = F.lit(0)
        for i, c in reversed(list(enumerate(clauses))):
            out = F.when(where & F.coalesce(F.expr(c.when), F.lit(False)), i + 1 + before).otherwise(out)
        return out

    def _value(self, name: str, clauses: list[Clause], inserted: bool = False) -> Column:
        kind = self.schema[name].dataType
        out = F.lit(None) if inserted else F.col(f"t.`{name}`")
        for i, c in enumerate(clauses):
            if c.values and name in c.values:
                out = F.when(F.col("_clause") == i + 1, F.expr(c.values[name]).cast(kind)).otherwise(out)
        return out.cast(kind).alias(name)


def _orders(t: Tables) -> VersionedTable:
    return VersionedTable.create(t.orders, scratch(t.spark), ["o_orderkey"], files=8)


def _changes(t: Tables) -> DataFrame:
    """Per order: lines and their price, for the orders of every third customer, and copies of some under new keys."""
    n = tasks(t.orders.count())
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").repartition(n, "o_orderkey")
    lines = lines.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    own = t.orders.where("o_custkey % 3 = 0").repartition(n, "o_orderkey").join(lines, "o_orderkey").select("o_orderkey", "o_custkey", "lines", "quantity")
    return own.unionByName(own.where("lines > 4").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


_CHANGES = """WITH lines AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey),
own AS (SELECT o_orderkey, o_custkey, lines, quantity FROM orders JOIN lines USING (o_orderkey) WHERE o_custkey % 3 = 0),
s AS (SELECT * FROM own UNION ALL SELECT o_orderkey + 1000000000, o_custkey, lines, quantity FROM own WHERE lines > 4)"""


@query(_CHANGES + """
SELECT o_orderkey, o_custkey, CASE WHEN s.o_orderkey IS NOT NULL AND s.quantity < 200 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NOT NULL AND s.quantity < 200 THEN s.quantity ELSE o_totalprice END AS o_totalprice
FROM orders t LEFT JOIN (SELECT o_orderkey, lines, quantity FROM s) s USING (o_orderkey) WHERE s.lines IS NULL OR s.lines > 1
UNION ALL SELECT o_orderkey, o_custkey, 'N', quantity FROM s WHERE o_orderkey >= 1000000000 AND quantity > 100""")
def merge_orders(t: Tables) -> DataFrame:
    """MERGE: matched orders of one line go, others with little in them are updated, unknown ones with much are inserted."""
    merged = (
        _orders(t).merge(_changes(t))
        .delete("s.lines = 1")
        .update({"o_orderstatus": "'U'", "o_totalprice": "s.quantity"}, "s.quantity < 200")
        .insert({"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": "'N'", "o_totalprice": "s.quantity"}, "s.quantity > 100")
        .run()
    )
    return merged.read().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE 'stale' END AS o_orderpriority FROM orders WHERE o_custkey % 3 = 0 OR o_orderstatus <> 'F'""")
def merge_by_source(t: Tables) -> DataFrame:
    """MERGE with rows that the source lacks: finished ones go, others are marked."""
    merged = _orders(t).merge(t.orders.where("o_custkey % 3 = 0").select("o_orderkey")).delete_unmatched("t.o_orderstatus = 'F'").update_unmatched({"o_orderpriority": "'stale'"}).run()
    return merged.read().select("o_orderkey", "o_orderpriority")


@query("""SELECT v, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
  SELECT 0 AS v, o_orderkey FROM orders UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 10 = 0) GROUP BY v""")
def table_versions(t: Tables) -> DataFrame:
    """Each version of a table that two merges changed, read back."""
    table, source = _orders(t), t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    table = table.merge(source.where("o_orderkey % 5 = 0")).delete().run()
    table = table.merge(source.where("o_orderkey % 10 = 0")).insert({c: f"s.{c}" for c in source.columns}).run()
    counts = [table.read(v).agg(F.lit(v).alias("v"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")) for v in table.versions()]
    return reduce(DataFrame.unionByName, counts)
