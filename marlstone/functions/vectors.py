"""Vectors held in arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables

#: Queries and vectors of one matrix product, and pairs that are summed exactly at once.
TOGETHER, ROWS, PAIRS = 256, 4096, 1 << 16


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of floats."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings""")
def vector_norm(t: Tables) -> DataFrame:
    """Length of each vector."""
    return t.embeddings.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("""SELECT q AS query_id, vec_id FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) DESC, b.vec_id) AS r
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE r <= 3""")
def nearest_vectors(t: Tables) -> DataFrame:
    """Three nearest neighbours of every fiftieth vector among all others."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(queries, t.embeddings, 3)


def _usable(v: Column) -> Column:
    """Whether an array of floats has components, all of them finite numbers."""
    wild = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~wild, F.lit(False))


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


class Best:
    """The ``k`` vectors of greatest product with each of some queries, among those seen so far.

    A matrix product gives each score but for the order of its sum. Those that may be among
    the best are summed again from the first component on, as the engine does, so
    equal vectors tie wherever they lie.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, vectors, k
        self.slack = 1e-15 * vectors.shape[1] * np.linalg.norm(vectors, axis=1)
        self.floor = np.full(len(ids), -np.inf)
        self.row, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        about = self.q @ vectors.T
        about[self.ids[:, None] == ids[None, :]] = -np.inf
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(about, -self.k, axis=1)[:, -self.k])
        slack = self.slack * np.linalg.norm(vectors, axis=1).max(initial=0.0)
        row, col = np.nonzero((about >= (floor - slack)[:, None]) & (about > -np.inf))
        sums = [np.add.accumulate(self.q[row[i : i + PAIRS]] * vectors[col[i : i + PAIRS]], axis=1)[:, -1] for i in range(0, len(row), PAIRS)]
        row, vec = np.concatenate([self.row, row]), np.concatenate([self.vec, ids[col]])
        score = np.concatenate([self.score, *sums])
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.vec, self.score = row[kept], vec[kept], score[kept]
        last = place == self.k - 1
        self.floor[row[last]] = score[last]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 32 << 20) -> DataFrame:
    """(query_id, vec_id): the ``k`` vectors of greatest dot product with each of ``queries`` (query_id, q), itself left out; least vec_id at ties.

    Ids are whole numbers. Rows with a null id, a null or empty vector, null or
    non-finite components, or another number of components than the longest query take no
    part; a query with fewer than ``k`` partners gets all. Queries are sent in blocks of
    ``block`` bytes, each held against all vectors in one pass; a task keeps ``k``
    rows for each query, and no pair of rows leaves it otherwise.
    """
    asked = queries.where(F.col("query_id").isNotNull() & _usable(F.col("q"))).select(F.col("query_id").cast("long"), F.col("q").cast("array<double>"))
    n, width = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    width = width or 1
    blocks = max(1, -(-n * 8 * width // block))
    fit = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == width) & _usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def pass_of(b: int) -> DataFrame:
        part = asked.where((F.size("q") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), _matrix(part["q"], width)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = [Best(ids[i : i + TOGETHER], q[i : i + TOGETHER], k) for i in range(0, len(ids), TOGETHER)]
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    some = batch.slice(i, ROWS)
                    v, m = some.column(0).to_numpy(), _matrix(some.column(1), width)
                    for x in best:
                        x.add(v, m)
            for x in best:
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.row]), pa.array(x.vec), pa.array(x.score)], names=["query_id", "vec_id", "s"])

        return fit.mapInArrow(search, "query_id long, vec_id long, s double")

    found = reduce(DataFrame.unionByName, map(pass_of, range(blocks)))
    first = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("query_id", "vec_id")
