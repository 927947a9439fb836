"""A table of Arrow segments as a Spark data source: batch and streaming, read and written, with filters that skip segments.

A folder that the driver and all executors mount holds ``data/`` with one Arrow file for
each task that wrote, and ``log/`` with one small JSON file for each commit, which names the
commit's segments with their rows and each column's least and greatest value. A commit
exists once its log file does: tasks write files under names of their own, and the driver
links the log file into place, which fails if that number is taken and is then tried with
the next one. So readers never see half a commit, a task that is tried twice leaves an unnamed file
and no rows, and writers may run side by side.

    save(df, path)
    load(spark, path, ("k", ">", 5), ("day", "in", [monday, tuesday]))
    spark.readStream.format("marlstone_segments").load(path)

Filters are given to the load, as an option: segments whose bounds rule one out aren't opened, and
of the others only rows that pass leave the reader. They compare columns of whole numbers, texts, dates
and times without a zone, or ask for nulls in any column; a null passes "null" alone, as in SQL. The engine's
own push-down into Python sources isn't used: it keeps the filters of the first plan of a
DataFrame for all later plans of it, which then lose rows. An overwrite is a commit that hides the
earlier ones; a stream that meets one fails, as rows that it has given out are gone. Rows arrive in any
order, an empty commit names no segment, and a folder without commits can't be read.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import scratch

#: Rows in a batch of a segment.
BATCH = 1 << 16
#: Comparisons that a load may be given.
OPS = {"=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual, "in": In}
#: Types of columns that can be compared so; doubles can't, as NaN is the greatest number in Spark and has no order in Arrow.
COMPARED = ("long", "integer", "short", "byte", "string", "date", "timestamp_ntz")
_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _folder(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("marlstone_segments needs a path")
    return path[len("file://") :] if path.startswith("file://") else path.removeprefix("file:")


def _plain(v):
    """A bound as JSON holds it; None if values of its type aren't bounded."""
    if isinstance(v, bool | int | str):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, datetime.datetime):
        return {"us": round((v.replace(tzinfo=v.tzinfo or datetime.UTC) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))}
    if isinstance(v, datetime.date):
        return {"day": v.toordinal()}
    return {"decimal": str(v)} if isinstance(v, decimal.Decimal) else None


def _ordered(v):
    """A bound or a filter's value as a number or text that compares as the column does."""
    v = v if isinstance(v, dict) else _plain(v)
    if isinstance(v, dict):
        ((kind, x),) = v.items()
        return decimal.Decimal(x) if kind == "decimal" else x
    return v


def _given(v):
    """The value that `_plain` made into JSON."""
    if isinstance(v, dict) and "us" in v:
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=v["us"])
    return datetime.date.fromordinal(v["day"]) if isinstance(v, dict) and "day" in v else v


def _filter(schema: StructType, name: str, op: str, value=None) -> Filter:
    """A filter of a load; raises if the table has no such column or it can't be compared."""
    if name not in schema.names:
        raise ValueError(f"no column {name} to filter by")
    if op in ("null", "not null"):
        return (IsNull if op == "null" else IsNotNull)((name,))
    if op not in OPS or schema[name].dataType.typeName() not in COMPARED:
        raise ValueError(f"{name} {op} can't be a filter of a load")
    return OPS[op]((name,), tuple(_given(v) for v in value) if op == "in" else _given(value))


def _bounds(table: pa.Table) -> dict:
    """Least and greatest value and nulls of each column; columns with NaN, or of nested types, have nulls alone."""
    out = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        kind, out[name] = column.type, {"nulls": column.null_count}
        if pa.types.is_nested(kind) or pa.types.is_binary(kind) or pa.types.is_null(kind) or column.null_count == len(column):
            continue
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            continue
        least, most = (_plain(v.as_py()) for v in pc.min_max(column).values())
        if least is not None and most is not None:
            out[name] |= {"least": least, "most": most}
    return out


def _joined(a: dict, b: dict) -> dict:
    """Bounds of two batches together."""
    out = {}
    for name in a:
        out[name] = {"nulls": a[name]["nulls"] + b[name]["nulls"]}
        known = [x for x in (a[name], b[name]) if "least" in x]
        if known and all("least" in x or x["nulls"] == x["rows"] for x in (a[name], b[name])):
            out[name] |= {"least": min((x["least"] for x in known), key=_ordered), "most": max((x["most"] for x in known), key=_ordered)}
    return out


def commits(folder: str) -> list[int]:
    """Numbers of the commits, in order."""
    try:
        return sorted(int(f[:-5]) for f in os.listdir(f"{folder}/log") if f.endswith(".json") and f[:-5].isdigit())
    except FileNotFoundError:
        return []


def commit(folder: str, n: int) -> dict:
    with open(f"{folder}/log/{n}.json", encoding="utf-8") as f:
        return json.load(f)


def publish(folder: str, entry: dict) -> int:
    """Add a commit under the next free number; the entry is whole before its name exists."""
    os.makedirs(f"{folder}/log", exist_ok=True)
    draft = f"{folder}/log/{uuid.uuid4().hex}.draft"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(entry, f)
    n = (commits(folder) or [0])[-1] + 1
    while True:
        try:
            os.link(draft, f"{folder}/log/{n}.json")
            os.unlink(draft)
            return n
        except FileExistsError:
            n += 1


def live(folder: str) -> list[dict]:
    """Segments of the last overwrite and of the commits after it."""
    out = []
    for n in reversed(commits(folder)):
        entry = commit(folder, n)
        out = entry["segments"] + out
        if entry["overwrite"]:
            break
    return out


def may_hold(segment: dict, f: Filter) -> bool:
    """False if no row of the segment can pass the filter, by its bounds alone."""
    column = segment["bounds"][f.attribute[0]]
    if isinstance(f, IsNull):
        return column["nulls"] > 0
    if column["nulls"] == segment["rows"]:
        return False
    if isinstance(f, IsNotNull) or "least" not in column:
        return True
    least, most = _ordered(column["least"]), _ordered(column["most"])
    if isinstance(f, In):
        return any(v is not None and least <= _ordered(v) <= most for v in f.value)
    v = _ordered(f.value)
    if v is None:
        return False
    return {EqualTo: least <= v <= most, GreaterThan: most > v, GreaterThanOrEqual: most >= v, LessThan: least < v, LessThanOrEqual: least <= v}[type(f)]


def passing(batch: pa.RecordBatch, f: Filter) -> pa.RecordBatch:
    """The rows of a batch that pass the filter; a null passes IS NULL alone."""
    column = batch.column(f.attribute[0])
    if isinstance(f, IsNull | IsNotNull):
        return batch.filter(pc.is_null(column) if isinstance(f, IsNull) else pc.is_valid(column))
    value = lambda v: pa.scalar(v, type=column.type)
    if isinstance(f, In):
        known = [value(v).as_py() for v in f.value if v is not None]
        return batch.filter(pc.fill_null(pc.is_in(column, pa.array(known, type=column.type)), False))
    if f.value is None:
        return batch.slice(0, 0)
    return batch.filter(pc.fill_null(_TESTS[type(f)](column, value(f.value)), False))


@dataclass
class _Segment(InputPartition):
    file: str


@dataclass
class _Written(WriterCommitMessage):
    segments: list[dict]


def _batches(file: str, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    with pa.OSFile(file, "rb") as source, pa.ipc.open_file(source) as reader:
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            for f in filters:
                batch = passing(batch, f)
            if batch.num_rows:
                yield batch


class _Reader(DataSourceReader):
    def __init__(self, folder: str, filters: list[Filter]):
        self.folder, self.filters = folder, filters

    def partitions(self) -> list[InputPartition]:
        return [_Segment(f"{self.folder}/data/{s['file']}") for s in live(self.folder) if all(may_hold(s, f) for f in self.filters)]

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.file, self.filters) if partition else ()


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": (commits(self.folder) or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for n in commits(self.folder):
            if start["commit"] < n <= end["commit"]:
                entry = commit(self.folder, n)
                if entry["overwrite"] and n > 1:
                    raise ValueError(f"commit {n} overwrote rows that a stream has given out")
                out += [_Segment(f"{self.folder}/data/{s['file']}") for s in entry["segments"]]
        return out

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.file, [])

    def commit(self, end: dict) -> None:
        """Nothing to clean up: segments belong to the table."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.schema, self.overwrite = folder, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One segment of a task's rows; no file if there are none."""
        name, sink, rows, bounds = f"{uuid.uuid4().hex}.arrow", None, 0, {}
        os.makedirs(f"{self.folder}/data", exist_ok=True)
        for batch in iterator:
            if not batch.num_rows:
                continue
            if sink is None:
                sink = pa.ipc.new_file(f"{self.folder}/data/{name}", batch.schema)
            sink.write_table(pa.Table.from_batches([batch]), max_chunksize=BATCH)
            new = _bounds(pa.Table.from_batches([batch]))
            for b in new.values():
                b["rows"] = batch.num_rows
            bounds = _joined(bounds, new) if rows else new
            rows += batch.num_rows
            for b in bounds.values():
                b["rows"] = rows
        if sink is None:
            return _Written([])
        sink.close()
        return _Written([{"file": name, "rows": rows, "bounds": bounds}])

    def commit(self, messages: list[_Written | None]) -> None:
        publish(self.folder, {"schema": self.schema, "overwrite": self.overwrite, "segments": [s for m in messages if m for s in m.segments]})

    def abort(self, messages: list[_Written | None]) -> None:
        """Remove what finished tasks wrote; nothing names it."""
        for m in messages:
            for s in m.segments if m else ():
                if os.path.exists(f"{self.folder}/data/{s['file']}"):
                    os.unlink(f"{self.folder}/data/{s['file']}")


class Segments(DataSource):
    """The data source ``marlstone_segments``; its one option is the path."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_segments"

    def schema(self) -> StructType:
        folder = _folder(self.options)
        numbers = commits(folder)
        if not numbers:
            raise ValueError(f"{folder} holds no commit")
        return StructType.fromJson(json.loads(commit(folder, numbers[-1])["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_folder(self.options), [_filter(schema, *f) for f in json.loads(self.options.get("filters", "[]"))])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_folder(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_folder(self.options), schema, overwrite)


def save(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``df`` as a commit of the table at ``path``."""
    df.sparkSession.dataSource.register(Segments)
    df.write.format("marlstone_segments").mode(mode).save(path)


def load(spark: SparkSession, path: str, *filters: tuple) -> DataFrame:
    """The rows of the table at ``path`` that pass all filters, each (column, one of `OPS`, value) or (column, "null" or "not null")."""
    spark.dataSource.register(Segments)
    told = [[name, op, *([_plain(v) for v in value] if op == "in" else _plain(value) for value in values)] for name, op, *values in filters]
    return spark.read.format("marlstone_segments").option("filters", json.dumps(told)).load(path)


def _orders(t: Tables) -> str:
    """Orders in segments of a range of keys each, in two commits."""
    path, orders = scratch(t.spark), t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    save(orders.where("o_orderstatus = 'F'").repartitionByRange("o_orderkey"), path)
    save(orders.where("o_orderstatus <> 'F'").repartitionByRange("o_orderkey"), path)
    return path


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey <= 1000 OR o_orderstatus = 'O' GROUP BY o_orderstatus")
def custom_source(t: Tables) -> DataFrame:
    """A source and a sink in Python, with filters that skip segments, in two reads of one table."""
    path = _orders(t)
    some = load(t.spark, path, ("o_orderkey", "<=", 1000)).unionByName(load(t.spark, path, ("o_orderkey", ">", 1000), ("o_orderstatus", "=", "O")))
    return some.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def custom_stream(t: Tables) -> DataFrame:
    """The same table as a stream of its commits."""
    from marlstone.streaming.events import run

    path = _orders(t)
    return run(t.spark.readStream.format("marlstone_segments").load(path).where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice"))
