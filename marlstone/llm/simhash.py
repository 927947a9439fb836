"""SimHash near-duplicates through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each read
as a word of the perfect binary Golay code [23, 12, 7]. Every word lies within
three bits of exactly one codeword. Two words that differ in at most one bit
share a key when one side gives its nearest codeword and the other side gives
its nearest and, if that one is three bits away, the five at four bits: a common
neighbour must be one of these. Three errors over three segments leave two
segments with at most one error each, so a pair of codeword indices (24 bits) is
a join key, for each of the three pairs of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import NO_ID, bounded, dropped, fresh, ready, staged, table
from marlstone.llm.graph import components

#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, counted with repeats; 0 without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return 0
    line = b" ".join(split)
    if n < words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - words])).tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(line[i:j], 42) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits; by 12-bit message: the check bits; by syndrome: five errors of four bits, or -1."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    checks = np.array([rest(m << 11) for m in range(4096)], dtype=np.int32)
    one = [rest(1 << i) for i in range(23)]
    nearest, four = np.full(2048, -1, np.int32), [[] for _ in range(2048)]
    for k in range(5):
        for bits in combinations(range(23), k):
            s, e = 0, 0
            for i in bits:
                s, e = s ^ one[i], e | 1 << i
            if k < 4:
                nearest[s] = e
            else:
                four[s].append(e)
    more = np.full((2048, 5), -1, np.int32)
    for s, found in enumerate(four):
        if found:
            more[s] = found
    return nearest, checks, more


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword, and (rows, 6) of all indices that stand for a segment, -1 where there are fewer."""
    nearest, checks, more = _golay()
    v = segment.astype(np.int32)
    s = checks[v >> 11] ^ (v & 0x7FF)
    near = (v ^ nearest[s]) >> 11
    extra = more[s]
    return near, np.column_stack([near, np.where(extra >= 0, (v[:, None] ^ extra) >> 11, -1)])


def _keys(fps: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: row numbers and keys."""
    u = fps.astype(np.int64).view(np.uint64)
    found = [codewords(((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        if wide:
            a, b = found[i][1].astype(np.int64), found[j][1].astype(np.int64)
            ok = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
            key = (p << 24) | (a[:, :, None] << 12) | b[:, None, :]
            r, _, _ = np.nonzero(ok)
            rows.append(r)
            keys.append(key[ok])
        else:
            rows.append(np.arange(len(u)))
            keys.append((p << 24) | (found[i][0].astype(np.int64) << 12) | found[j][0])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the SimHash of every whole text, as a signed long."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], schema=out)

    return slim.mapInArrow(work, "doc_id long, text_hash long, fp long")


def _keyed(fps: DataFrame, wide: bool) -> DataFrame:
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).to_numpy(zero_copy_only=False)
                rows, keys = _keys(v, wide)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[rows])], schema=out)

    return fps.select("fp").mapInArrow(work, "key long, fp long")


def _by_midpoints(fps: DataFrame) -> DataFrame:
    """Links that connect all fingerprints within three bits of each other, by linear work.

    Two such fingerprints have a midpoint within one bit of one and two of the
    other. Everything that reaches a midpoint which some fingerprint reaches by
    one bit is linked to the least of those. No group has over 2,146 rows.
    """
    one = [0, *(1 << i for i in range(64))]
    two = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = lambda xs: F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in xs])
    near = fps.select("fp", F.explode(signed(one)).alias("m"), F.lit(True).alias("near"))
    far = fps.select("fp", F.explode(signed(two)).alias("m"), F.lit(False).alias("near"))
    reach = near.unionByName(far).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid"), "near")
    root = reach.where("near").groupBy("mid").agg(F.min("fp").alias("root"))
    return reach.join(root, "mid").where("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, bits: int = 3, hot: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most three bits.

    Each link is found by a key that both share and then verified. A key that
    over ``hot`` fingerprints have as their nearest one leaves this join; the
    fingerprints that have it are linked through common midpoints instead, which
    gives the same components by work that is linear in their number.
    """
    if bits > 3:
        raise ValueError("Golay keys over three segments find up to three differing bits")
    left, right = _keyed(fps, False), _keyed(fps, True)
    crowded = staged(left.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
    extra = None
    if not crowded.isEmpty():
        members = left.unionByName(right).join(crowded, "key", "left_semi").select("fp").distinct()
        extra = _by_midpoints(members)
        left = left.join(crowded, "key", "left_anti")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        left.withColumnRenamed("fp", "a").hint("shuffle_hash")
        .join(right.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") < F.col("b")) & (differ <= bits))
        .select("a", "b")
    )
    return pairs if extra is None else pairs.unionByName(extra)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; ``with_hash`` adds text_hash and group, the least fingerprint of the component.

    Equal fingerprints form a class; classes within ``bits`` differing bits are
    linked; component_id is the least doc_id that links reach. A null or empty
    text has fingerprint 0 and is linked like any other. Rows without a doc_id
    take part in links but never name a component (null if nothing else does);
    repeated rows come back as often as they went in. An empty table gives no rows.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    tree = components(links(classes, bits))
    named = classes.join(tree, classes["fp"] == tree["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = staged(named.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id", F.col("root").alias("group")), "class_components")
    dropped(classes)
    return rows.join(of, rows["fp"] == of["class_fp"]).select("doc_id", "fp", "component_id", *["text_hash", "group"] * with_hash)


#: Documents that are similar, not only near in fingerprint: segments of 23 bits, the full length of the code, in pairs.
WIDE_SEGMENTS = 4
WIDE_PAIRS = tuple(combinations(range(WIDE_SEGMENTS), 2))
#: A shingle's weight in a segment is the inverse of a number in (0, 1], squared, so that a few shingles decide most of a segment's bits.
STEEP = 2
#: Bits in which 64-bit fingerprints of equal weights may differ: 9.7 in the mean at a similarity of 0.8.
APART = 24
#: Up to so many classes of one key are compared pair by pair; beyond, with the least of them, and what that leaves apart by the rarest shingles.
PAIRED = 16
#: Bits in which the parities of two sets' elements are compared before the sets are, in numbers of 64.
PARITIES = 512


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order; of the whole sequence where it has fewer words; none without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(split)
    h = xxhash.xxh64_intdigest
    if n < words:
        return np.array([h(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words])).tolist()
    return np.unique(np.fromiter((h(line[i:j], 42) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n - words + 1))


def parities(held: np.ndarray) -> np.ndarray:
    """PARITIES bits of a set of 32-bit numbers: how many of its elements fall on each, modulo 2. Where two sets differ in a bit they differ in an element, so they never differ in more bits than elements."""
    at = (held.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITIES.bit_length() + 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1, bitorder="little").view("<i8")


def _turned(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash, the ``k``-th."""
    h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray, weights: np.ndarray, n: int) -> int:
    """The first ``n`` bits of the SimHash of hashes with weights."""
    total = np.zeros(64)
    for i in range(0, len(h), 1 << 14):
        total += weights[i : i + (1 << 14)] @ np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * total > weights.sum(), bitorder="little").view("<u8")[0]) & ((1 << n) - 1)


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[int, int, int, int]:
    """Four segments of 23 bits in two numbers, a 64-bit SimHash of equal weights, and the number of distinct shingles.

    With equal weights an edit flips bits in all segments: at a similarity of 0.8,
    each differs in three or four bits. Here each segment has weights of its own,
    which fall steeply; an edit that misses a segment's few heavy shingles flips no
    bit of it or one, which the code repairs, and others lose a whole segment.
    """
    h = shingles(text, words)
    if not len(h):
        return 0, 0, 0, 0
    segments = []
    for s in range(WIDE_SEGMENTS):
        u = ((_turned(h, 2 * s + 1) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        segments.append(_bits(_turned(h, 2 * s + 2), u ** -float(STEEP), 23))
    return segments[0] | segments[1] << 23, segments[2] | segments[3] << 23, _bits(h, np.ones(len(h)), 64), len(h)


def _wide_keys(batch: pa.RecordBatch, wide: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and join keys: a pair of codeword indices, and the logarithm of the number of shingles in units of 1 / ``similarity``, for which the near side gives three values."""
    lo, hi, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
    found = [codewords((v >> at) & ((1 << 23) - 1)) for v in (lo, hi) for at in (0, 23)]
    size = np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity)).astype(np.int64)
    rows, keys = [], []
    for p, (i, j) in enumerate(WIDE_PAIRS):
        if wide:
            a, b = found[i][1].astype(np.int64), found[j][1].astype(np.int64)
            ok = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
            r, x, y = np.nonzero(ok)
            rows.append(r)
            keys.append(size[r] << 27 | p << 24 | a[r, x] << 12 | b[r, y])
        else:
            for d in (-1, 0, 1):
                rows.append(np.arange(len(n)))
                keys.append((size + d + 1) << 27 | p << 24 | found[i][0].astype(np.int64) << 12 | found[j][0])
    return np.concatenate(rows), np.concatenate(keys) + (np.int64(1 << 27) if wide else np.int64(0))


def _wide_keyed(classes: DataFrame, wide: bool, similarity: float) -> DataFrame:
    """(key, id, fp, n) of classes (id, lo, hi, fp, n)."""
    out = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, keys = _wide_keys(batch, wide, similarity)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[batch.column(k).take(at) for k in (0, 3, 4)]], schema=out)

    return classes.select("id", "lo", "hi", "fp", "n").mapInArrow(work, "key long, id long, fp long, n long")


def _near(similarity: float) -> Column:
    return (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= APART) & (F.least("n", "n_b") >= similarity * F.greatest("n", "n_b")) & (F.col("id") != F.col("id_b"))


def candidates(classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes (id, lo, hi, fp, n) that share a key and may be similar by fingerprint and size; and (key, id), the members of crowded keys.

    Of a key that over PAIRED classes have as their near one, the least alone is
    paired with the others, which is linear work; ``rest`` finds what that leaves.
    """
    left, right = _wide_keyed(classes, False, similarity), _wide_keyed(classes, True, similarity)
    crowded = bounded(staged(left.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("head")).where(F.col("members") > PAIRED), "crowded"))
    few, many = left.join(crowded, "key", "left_anti"), staged(left.join(crowded, "key"), "crowded_rows")
    heads = many.where("id = head").select("key", "id", "fp", "n", F.lit(True).alias("crowded"))
    other = right.select("key", F.col("id").alias("id_b"), F.col("fp").alias("fp_b"), F.col("n").alias("n_b"))
    met = few.withColumn("crowded", F.lit(False)).unionByName(heads).hint("shuffle_hash").join(other, "key").withColumn("near", _near(similarity))
    met = staged(met.where("near or crowded").select("key", "id", "id_b", "crowded", "near"), "met")
    pairs = met.where("near").select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
    return pairs, many.select("key", "id").unionByName(met.where("crowded").select("key", F.col("id_b").alias("id")))


def _linked(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets in ``held`` (id, held) have a Jaccard similarity of at least ``similarity``."""
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("held").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
    return both.where(F.col("common") >= similarity * (F.col("all") - F.col("common")) - 1e-9).select("a", "b")


def _prefixes(held: DataFrame, similarity: float) -> DataFrame:
    """(token, id, n, at): the rarest elements of each of n in ``held`` (id, held), by place; sets of at least ``similarity`` have one of them in common.

    Such sets differ in at most n - similarity * n elements of either, so one more,
    in any order that is the same for all, can't all be missing from the other.
    """
    each = held.select("id", F.size("held").alias("n"), F.explode("held").alias("token"))
    often = bounded(staged(each.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "shared_tokens"))
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("sets", F.lit(1)).alias("sets"), "token")))
    ranked = each.join(often, "token", "left").groupBy("id").agg(F.first("n").alias("n"), order.alias("order"))
    first = ranked.select("id", "n", F.posexplode(F.slice("order", F.lit(1), F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1)).alias("at", "e"))
    return first.where("e.sets > 1").select("e.token", "id", "n", "at")


def _apart(similarity: float) -> Column:
    """Whether two sets with an element in common, at their places ``at`` and ``at_b``, belong to different roots and may be similar if it is the first they share.

    Their parities bound the number of elements that only one of them has from below,
    so near misses are told here, before pairs are made; no similar pair is lost.
    """
    needed = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-9)
    differ = sum((F.bit_count(F.col("parities")[k].bitwiseXOR(F.col("parities_b")[k])) for k in range(1, PARITIES // 64)), F.bit_count(F.col("parities")[0].bitwiseXOR(F.col("parities_b")[0])))
    placed = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= needed
    return (F.col("root") != F.col("root_b")) & placed & (differ <= F.col("n") + F.col("n_b") - 2 * needed)


def rest(crowd: DataFrame, links: DataFrame, held_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar members of crowded keys (key, id) that ``links`` leaves apart, with ``links``; ``held_of`` gives (id, held, parities) of ids.

    Keys whose members are connected need no more. Of the others, sets of different
    roots that share one of their rarest elements are compared. An element's members of
    the root that has most of them aren't paired with each other, so a large group costs
    only what is outside of it.
    """
    tree = staged(components(links), "tree")
    rooted = crowd.join(tree, crowd["id"] == tree["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    roots = staged(rooted.join(several, "key").select("id", "root").distinct(), "open_roots")
    if roots.isEmpty():
        return links
    held = held_of(roots.select("id"))
    rows = staged(_prefixes(held, similarity).join(bounded(roots), "id"), "prefixes")
    largest = F.floor((1 + similarity) / similarity * (F.col("n") - F.col("at")) - F.col("n") + 1e-6)  # the largest set that may be similar
    least = rows.groupBy("token").agg(F.min("n").alias("least_n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    rows = rows.join(bounded(staged(least.select("token", "least_n"), "open_tokens")), "token")
    rows = staged(rows.where(largest >= F.col("least_n")).drop("least_n"), "open_prefixes")
    counted = rows.groupBy("token", "root").agg(F.count("*").alias("sets"))
    most = counted.groupBy("token").agg(F.max(F.struct("sets", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    most = bounded(staged(most.select("token", F.col("most.root").alias("main")), "main_roots"))
    rows = rows.join(held.select("id", "parities"), "id")
    other = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "at", "root", "parities")])
    both = rows.join(most, "token").where("root <> main").join(other, "token")
    both = both.where(_apart(similarity) & ((F.col("root_b") == F.col("main")) | (F.col("id") < F.col("id_b"))))
    pairs = staged(both.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct(), "open_pairs")
    return links.unionByName(_linked(pairs, held, similarity))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, group, component_id) for every row of ``docs``: near-duplicates by ``words``-word shingles.

    Documents with the same shingles form a class. Classes that share a key are
    candidates; those whose shingles have a Jaccard similarity of at least
    ``similarity`` are linked, and connected ones form a group. component_id is its
    least doc_id. Texts without words are one class. Rows without a doc_id never
    name a group (null if nothing else does); repeated rows come back as often as
    they went in. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "lo", "hi", "fp", "n")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, k]) for k in range(4)]], schema=out)

    rows = staged(slim.mapInArrow(work, "doc_id long, text_hash long, lo long, hi long, fp long, n long").withColumn("id", F.xxhash64("lo", "hi", "fp", "n")), "fingerprints")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_hash"))
    classes = staged(rows.groupBy("id", "lo", "hi", "fp", "n").agg(least.alias("first"), F.min("doc_id").alias("first_id")), "classes")
    sets = pa.schema([("id", pa.int64()), ("held", pa.list_(pa.int32())), ("parities", pa.list_(pa.int64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingles(t.as_py(), words).astype(np.uint32)).view(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32())), pa.array([parities(x) for x in held], pa.list_(pa.int64()))], schema=sets)

    def held_of(ids: DataFrame) -> DataFrame:
        wanted = bounded(staged(classes.join(ids, "id").select("id", "first.*"), "candidate_documents"))
        key = (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == wanted["doc"]) & (slim["text_hash"] == wanted["text_hash"])
        texts = slim.join(wanted, key).select("id", "text")
        return staged(texts.mapInArrow(hashed, "id long, held array<int>, parities array<long>").dropDuplicates(["id"]), "candidate_shingles")

    found, crowd = candidates(classes, similarity)
    pairs = staged(found, "candidates")
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate_ids")
    links = staged(_linked(pairs, held_of(ids), similarity), "links")
    tree = components(rest(crowd, links, held_of, similarity))
    named = classes.join(tree, classes["id"] == tree["node"], "left").select("id", "first_id", F.coalesce("root", "id").alias("group"))
    first = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    of = staged(named.join(first, "group").select("id", "group", "component_id"), "class_groups")
    return rows.join(of, "id").select("doc_id", "text_hash", "group", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are first of their group of near-duplicates, with the same columns.

    First is the row of least doc_id, and among equal ones of least text hash; of
    rows that agree in both, one stays. Rows without a doc_id come last.
    """
    groups = staged(similar_documents(docs.select("doc_id", "text"), words, similarity), "groups")
    least = groups.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), "text_hash")).alias("m"))
    key, mark, kept_id, kept_hash = fresh(docs, "dedup_id", "dedup_hash", "kept_id", "kept_hash")
    kept = least.select(F.col("m.i").alias(kept_id), F.col("m.text_hash").alias(kept_hash))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(mark, F.xxhash64("text"))
    rows = keyed.join(kept, (F.col(key) == F.col(kept_id)) & (F.col(mark) == F.col(kept_hash))).select(*docs.columns, key, mark)
    return rows.dropDuplicates([key, mark]).select(*docs.columns)


def op5_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
