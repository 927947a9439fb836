"""Hard negatives by branch-and-bound over ball trees of partitions.

Rows are dealt to trees by their nearest pivot, so each tree covers a small part
of the space; a pivot with many rows has several trees. A tree's nodes are balls:
a search's inner product with any row of a ball lies within ``q.c - |q| r`` and
``q.c + |q| r``. A node is left out if those bounds lie outside the search's window
of scores, strictly beneath its current k-th score, or if the node's labels rule it
out. All searches of a batch go down a tree together, so the work is done by matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, ready, staged, table

#: Rows of a leaf, and searches that go down a tree together.
LEAF, BATCH = 64, 2048
#: Least and most rows of a tree, about, and most of its components.
TREE, CELLS = (2_000, 50_000), 4_000_000
#: Pivots at most, taken from the rows of least hash; balls of trees that searches are held against at a time.
PIVOTS, BALLS = 256, 2048
#: Searches that share one copy of a tree.
SHARED = 200_000
LOW, HIGH = np.int64(-(2**63)), np.int64(2**63 - 1)


class BallTree:
    """A tree over rows (vectors of whole numbers, ids, row numbers, labels), halved along the line between two far rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.vectors = vectors
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.spans)
            self.spans.append((a, b))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (node, -1) if side == 0 else (self.children[parent][0], node)
            if b - a > LEAF:
                mid = self._halve(a, b)
                todo += [(mid, b, node, 1), (a, mid, node, 0)]
        self.vectors, self.ids, self.rows, self.labels = vectors[self.order], ids[self.order], rows[self.order], labels[self.order]
        n, d = len(self.spans), vectors.shape[1]
        self.centers, self.radii = np.empty((n, d)), np.empty(n)
        self.low_label, self.high_label = np.empty(n, np.int64), np.empty(n, np.int64)
        for i, (a, b) in enumerate(self.spans):
            self.centers[i] = self.vectors[a:b].mean(axis=0)
            self.radii[i] = np.sqrt(np.square(self.vectors[a:b] - self.centers[i]).sum(axis=1).max())
            self.low_label[i], self.high_label[i] = self.labels[a:b].min(), self.labels[a:b].max()

    def _halve(self, a: int, b: int) -> int:
        own = self.vectors[self.order[a:b]]
        far = own[np.square(own - own.mean(axis=0)).sum(axis=1).argmax()]
        other = own[np.square(own - far).sum(axis=1).argmax()]
        half = (b - a) // 2
        self.order[a:b] = self.order[a:b][np.argpartition(own @ (other - far), half)]
        return a + half

    def search(self, s: Searches) -> None:
        """Put this tree's rows into the searches' best."""
        todo = [(0, np.arange(len(s.low)))]
        while todo:
            node, who = todo.pop()
            who = who[s.may_hold(self, node, who)]
            if not len(who):
                continue
            if self.children[node] is None:
                a, b = self.spans[node]
                s.offer(who, self.vectors[a:b], self.ids[a:b], self.rows[a:b], self.labels[a:b])
            else:
                left, right = self.children[node]
                towards = s.vectors[who].mean(axis=0) @ (self.centers[right] - self.centers[left])
                todo += [(left, who), (right, who)] if towards > 0 else [(right, who), (left, who)]


class Searches:
    """A batch of searches: vector, own row, label, whether rows of that label or of others are sought, window of scores, least score that counts, and the k best so far."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, alike: bool, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        self.vectors, self.rows, self.labels, self.alike, self.low, self.high = vectors, rows, labels, alike, low, high
        self.norms = np.sqrt(np.square(vectors).sum(axis=1))
        self.floor = np.maximum(low, floor)
        self.scores, self.ids = np.full((len(rows), k), LOW), np.full((len(rows), k), HIGH)
        self.filled = np.zeros((len(rows), k), bool)

    def may_hold(self, tree: BallTree, node: int, who: np.ndarray) -> np.ndarray:
        middle, reach = self.vectors[who] @ tree.centers[node], self.norms[who] * tree.radii[node]
        slack = 1e-6 + 1e-9 * (reach + self.norms[who] * np.sqrt(np.square(tree.centers[node]).sum()))
        first, last, label = tree.low_label[node], tree.high_label[node], self.labels[who]
        fits = (first <= label) & (label <= last) if self.alike else (first != label) | (last != label)
        return fits & (middle + reach + slack >= self.floor[who]) & (middle - reach - slack <= self.high[who])

    def offer(self, who: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        scores = inner(self.vectors[who], vectors)
        fits = (labels[None] == self.labels[who][:, None]) == self.alike
        fits &= (rows[None] != self.rows[who][:, None]) & (scores <= self.high[who][:, None])
        kth, kth_id = self.scores[who, -1][:, None], self.ids[who, -1][:, None]
        fits &= (scores >= self.floor[who][:, None]) & (~self.filled[who, -1][:, None] | (scores > kth) | ((scores == kth) & (ids[None] < kth_id)))
        some = fits.any(axis=1)
        if not some.any():
            return
        who, fits, scores = who[some], fits[some], scores[some]
        k = self.scores.shape[1]
        scores = np.hstack([self.scores[who], scores])
        filled = np.hstack([self.filled[who], fits])
        ids = np.hstack([self.ids[who], np.broadcast_to(ids, fits.shape)])
        # filled ones first, then by falling score, then by rising id; ~x falls as x rises and never overflows
        best = np.lexsort((ids, ~scores, ~filled), axis=-1)[:, :k]
        self.scores[who], self.ids[who], self.filled[who] = (np.take_along_axis(x, best, 1) for x in (scores, ids, filled))
        full = self.filled[who, -1]
        self.floor[who[full]] = np.maximum(self.floor[who[full]], self.scores[who[full], -1])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those that no long holds raise."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return (exact(a) @ exact(b).T).astype(np.int64)


# --- rows and trees -------------------------------------------------------------


def prepared(vectors: DataFrame, relabel: str | None = None) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part: label and vector there, each component finite and brought down to a whole number as floor(256 * x)."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").withColumn("vec", parts).where(whole)
    if relabel is not None:
        rows = rows.withColumn("label", F.expr(relabel).cast("long"))
    # from 2^53 on a double is whole
    floored = F.transform("vec", lambda x: F.when(F.abs(x * 256) < 2.0**53, F.floor(x * 256).cast("double")).otherwise(x * 256))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", floored.alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers; shorter ones end in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (ends == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def dealt(rows: DataFrame, n: int, width: int) -> DataFrame:
    """``rows`` with their tree: the nearest of at most PIVOTS pivots, and a share of its rows that a hash gives where they are many.

    Pivots are the rows of least hash, a bounded sample that only shapes the trees;
    every row is in one.
    """
    spark = rows.sparkSession
    size = max(LEAF, min(TREE[1], CELLS // width, max(TREE[0], n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    chosen = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(min(PIVOTS, -(-n // size))).collect()
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r["vec"])] = r["vec"]
    square = np.square(pivots).sum(axis=1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (square[None] - 2 * matrix(batch.column("vec"), width) @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "pivot"])

    placed = staged(rows.mapInArrow(nearest, "row long, vec_id long, label long, vec array<double>, pivot long"), "placed")
    share = F.ceil(F.count("*") / size)
    shares = placed.groupBy("pivot").agg(share.cast("long").alias("shares"))  # one row for each pivot
    return placed.join(F.broadcast(shares), "pivot").withColumn("tree", F.col("pivot") * 2**32 + F.pmod(F.xxhash64("row"), F.col("shares"))).drop("pivot", "shares")


def searched(rows: DataFrame, searches: DataFrame, width: int, k: int, alike: bool) -> DataFrame:
    """(search, score, vec_id): what each tree has to say of the searches sent to it, at most ``k`` rows a search and tree.

    ``rows`` have a tree, ``searches`` (search, tree, vec, row, label, low, high,
    floor) too. Both are dealt by tree and sorted so that a task meets a tree's rows
    before its searches: it holds one tree and one batch of searches at a time. Many
    searches of a tree are cut into parts that each have a copy of the tree.
    """
    spark = rows.sparkSession
    many = searches.groupBy("tree").agg(F.ceil(F.count("*") / SHARED).cast("long").alias("parts"))
    own = rows.join(many, "tree").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("tree", "part", F.lit(None).cast("long").alias("search"), "row", "vec_id", "label", "vec", *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "floor")])
    asked = searches.join(many, "tree").select("tree", F.pmod(F.xxhash64("search"), F.col("parts")).alias("part"), "search", "row", F.lit(0).cast("long").alias("vec_id"), "label", "vec", "low", "high", "floor")
    both = own.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", "part").sortWithinPartitions("tree", "part", F.col("search").asc_nulls_first())
    names = ["search", "score", "vec_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, waiting = None, [], None, []

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal tree, waiting
            if not waiting:
                return
            if tree is None:
                t = pa.Table.from_batches(held).combine_chunks()
                column = lambda c: t.column(c).to_numpy()
                tree = BallTree(matrix(t.column("vec").combine_chunks(), width), t.column("vec_id").fill_null(HIGH).to_numpy(), column("row"), column("label"))
                held.clear()
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
            number = lambda c: t.column(c).to_numpy()
            s = Searches(matrix(t.column("vec").combine_chunks(), width), number("row"), number("label"), alike, number("low"), number("high"), number("floor"), k)
            tree.search(s)
            who, place = np.nonzero(s.filled)
            cols = (number("search")[who], s.scores[who, place], s.ids[who, place])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            keys = np.stack([batch.column("tree").to_numpy(), batch.column("part").to_numpy(), batch.column("search").is_valid().to_numpy(zero_copy_only=False)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key, asks = tuple(keys[a, :2]), bool(keys[a, 2])
                if key != at:
                    yield from answered()
                    at, tree = key, None
                    held.clear()
                if not asks:
                    held.append(batch.slice(a, b - a))
                    continue
                for c in range(a, b, BATCH):
                    waiting.append(batch.slice(c, min(BATCH, b - c)))
                    if sum(x.num_rows for x in waiting) >= BATCH:
                        yield from answered()
        yield from answered()

    return both.mapInArrow(work, "search long, score long, vec_id long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each search, ranked by falling score and rising id; each task keeps no more than ``k`` of a search before any row moves."""
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reaching(searches: DataFrame, balls: DataFrame, width: int, alike: bool) -> DataFrame:
    """``searches`` with each tree but their home whose ball they can't leave out, by the bounds that nodes have.

    Balls (tree, center, radius, low_label, high_label), one row for each tree, come to
    the driver in blocks of BALLS, and each block goes to the tasks of the searches.
    """
    out, last = None, -1
    while block := balls.where(F.col("tree") > last).orderBy("tree").limit(BALLS).collect():
        last = block[-1]["tree"]
        centers = np.zeros((len(block), width))
        for i, r in enumerate(block):
            centers[i, : len(r["center"])] = r["center"]
        trees, radii, first, final = (np.array([r[c] for r in block]) for c in ("tree", "radius", "low_label", "high_label"))

        def work(batches: Iterator[pa.RecordBatch], centers=centers, trees=trees, radii=radii, first=first, final=final) -> Iterator[pa.RecordBatch]:
            lengths = np.sqrt(np.square(centers).sum(axis=1))
            for batch in batches:
                q = matrix(batch.column("vec"), width)
                norm, label = np.sqrt(np.square(q).sum(axis=1))[:, None], batch.column("label").to_numpy()[:, None]
                middle, reach = q @ centers.T, norm * radii[None]
                slack = 1e-6 + 1e-9 * (reach + norm * lengths[None])
                fits = (first[None] <= label) & (label <= final[None]) if alike else (first[None] != label) | (final[None] != label)
                fits &= trees[None] != batch.column("tree").to_numpy()[:, None]
                fits &= (middle + reach + slack >= np.maximum(batch.column("low").to_numpy(), batch.column("floor").to_numpy())[:, None]) & (middle - reach - slack <= batch.column("high").to_numpy()[:, None])
                who, at = np.nonzero(fits)
                for c in range(0, len(who), 4096):
                    t = batch.take(pa.array(who[c : c + 4096]))
                    yield t.set_column(t.schema.get_field_index("tree"), "tree", pa.array(trees[at[c : c + 4096]], pa.int64()))

        part = searches.mapInArrow(work, searches.schema)
        out = part if out is None else out.unionByName(part)
    return searches.limit(0) if out is None else out


def best(rows: DataFrame, balls: DataFrame, searches: DataFrame, width: int, k: int, alike: bool) -> DataFrame:
    """(search, score, vec_id, rank): the ``k`` best rows of each search over all trees.

    Every search first asks its home tree. The k-th score that it finds there is the
    floor for the other trees: those whose whole ball lies beneath are not asked.
    """
    home = staged(searched(rows, searches, width, k, alike), "home")
    floors = best_of(home, k).where(F.col("rank") == k).select("search", F.col("score").alias("kth"))
    known = searches.join(floors, "search", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(int(LOW))))).select(searches.columns)
    away = staged(reaching(staged(known, "known"), balls, width, alike), "away")
    return best_of(home.unionByName(searched(rows, away, width, k, alike)), k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), relabel: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, a row of ``vectors`` (vec_id, embedding, label) whose vec_id ``every`` divides.

    An anchor's positives are its first other rows of the same label by inner product;
    for each, its negatives are the first rows of another label whose score is
    between ``window`` per cent of the positive's. ``relabel`` is an SQL expression of
    vec_id and label that takes the label's place. Scores are those of whole numbers,
    floor(256 * x) for each component. Rows with a null label or vector, or a null or
    non-finite component, take no part. Vectors of unlike lengths are compared as if the
    shorter ended in zeros. A row without vec_id is no anchor, comes last among equal
    scores, and its id is null in the result. Repeated rows are rows each: they can be
    each other's positives, and a repeated anchor has its results as often. A score
    that no long holds raises. An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = staged(prepared(vectors, relabel), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = max(1, width or 0)
    placed = staged(dealt(rows, n, width), "trees")
    balls = staged(_balls(placed, width), "balls")
    every_score = {"low": int(LOW), "high": int(HIGH), "floor": int(LOW)}
    anchors = placed.where(F.col("vec_id") % every == 0)
    first = anchors.select(F.col("row").alias("search"), "tree", "vec", "row", "label", *[F.lit(v).cast("long").alias(c) for c, v in every_score.items()])
    found = best(placed, balls, first, width, positives, True)
    paired = staged(found.select(F.col("search").alias("anchor"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"), (F.col("search") * positives + F.col("rank") - 1).alias("search")), "positives")
    score = F.col("positive_score").cast("decimal(19,0)")
    limits = [F.ceil(score * window[0] / 100).cast("long").alias("low"), F.floor(score * window[1] / 100).cast("long").alias("high")]
    second = paired.select("search", "anchor", *limits).where("low <= high").join(anchors, F.col("anchor") == F.col("row"))
    second = second.select("search", "tree", "vec", "row", "label", "low", "high", F.lit(int(LOW)).alias("floor"))
    hard = best(placed, balls, staged(second, "windows"), width, negatives, False)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id").join(paired, "search").join(named, "anchor")
    out = staged(out.select("anchor_id", F.nullif("positive_id", F.lit(int(HIGH))).alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.nullif("negative_id", F.lit(int(HIGH))).alias("negative_id"), "positive_score", "negative_score"), "negatives")
    dropped(rows, placed, balls, paired)
    return out


def _balls(placed: DataFrame, width: int) -> DataFrame:
    """One row for each tree, whose size is bounded: its ball and the range of its labels."""

    def ball(rows: pa.Table) -> pa.Table:
        own = np.vstack([matrix(c, width) for c in rows.column("vec").chunks])
        center, label = own.mean(axis=0), rows.column("label").to_numpy()
        radius = float(np.sqrt(np.square(own - center).sum(axis=1).max()))
        return pa.table({"tree": rows.column("tree")[:1], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": [radius], "low_label": [int(label.min())], "high_label": [int(label.max())]})

    return placed.select("tree", "label", "vec").groupBy("tree").applyInArrow(ball, "tree long, center array<double>, radius double, low_label long, high_label long")


#: The query's change of labels: vec_ids that 7 divides take the next label of ten.
SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: hard negatives of every hundredth vector."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), relabel=SHIFTED)


ORACLE = """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""
