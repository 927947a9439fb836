"""Substring dedup: windows of fifty words, counted exactly in super-k-mer buckets.

The minimiser of a window is the least hash among its runs of eight words.
Windows that follow each other and share it travel as one string of words to the
bucket of the minimiser: equal windows have equal minimisers, so a bucket sees
all copies of its windows, and sorts them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import NO_ID, ready, staged, table

WINDOW, RUN = 50, 8
#: Bases of polynomial hashes modulo 2^64: odd numbers of no special form.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes hashed at a time, rows of a bucket sorted at a time.
CHUNK, ROWS = 1 << 20, 4096
#: A minimiser of more windows than this has them counted one by one, by an aggregate over all tasks.
HOT = 400_000


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    one = np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64)))
    other = np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64)))
    return np.cumprod(one), np.cumprod(other)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair; it depends on the values alone."""
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(base, size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
    return _mixed((total[ends] - total[starts]) * down[starts])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(CHUNK, int(lengths.sum()) + CHUNK, CHUNK), side="left") + 1
    out, at = [], 0
    for cut in np.minimum(cuts, len(words)).tolist():
        if cut > at:
            data = np.frombuffer(b"".join(words[at:cut]), np.uint8).astype(np.uint64) + np.uint64(1)
            ends = np.cumsum(lengths[at:cut])
            out.append(_ranges(data, ends - lengths[at:cut], ends, BYTE_BASE))
            at = cut
    return np.concatenate(out)


def minimisers(hashes: np.ndarray, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """The minimiser of every window of a document, given its words' hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = _runs(hashes, run, WORD_BASES[0])
    have, want = 1, window - run + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _runs(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    out = []
    for at in range(0, len(hashes) - n + 1, CHUNK):
        part = hashes[at : at + CHUNK + n - 1]
        starts = np.arange(len(part) - n + 1)
        out.append(_ranges(part, starts, starts + n, base))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def super_kmers(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch with one minimiser."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
    return starts, np.diff(np.concatenate((starts, [len(least)])))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    starts = np.nonzero(edge == 1)[0]
    return starts, np.nonzero(edge == -1)[0] - starts


def window_classes(words: list[bytes], window: int) -> np.ndarray:
    """For each run of ``window`` words a number that equal runs alone share.

    Words are numbered, then pairs of neighbouring runs of 1, 2, 4, ... words, each
    time by sorting; so equality is that of the words themselves, not of hashes.
    """
    ids: dict[bytes, int] = {}
    code, size = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)), 1
    while size < window and len(code):
        step = min(size, window - size)
        code = np.unique(code[: len(code) - step] * (code.max() + 1) + code[step:], return_inverse=True)[1]
        size += step
    return code


def _judge(rows: list[tuple[int, int, int, bytes]], window: int) -> tuple[list, list, list, list]:
    """Of super-k-mers (doc, text_hash, first window, words), all those of some minimisers: stretches of windows that a lesser doc has too."""
    split = [words.split(b" ") for *_, words in rows]
    code = window_classes([w for words in split for w in words], window)
    ends = np.cumsum([len(words) for words in split])
    sizes = [len(words) - window + 1 for words in split]
    at = np.concatenate([np.arange(end - n - window + 1, end - window + 1) for end, n in zip(ends.tolist(), sizes, strict=True)])
    code, d = code[at], np.repeat(np.array([row[0] for row in rows], np.int64), sizes)
    order = np.argsort(code, kind="stable")
    new = np.concatenate(([True], code[order][1:] != code[order][:-1]))
    least = np.minimum.reduceat(d[order], np.nonzero(new)[0])[np.cumsum(new) - 1]
    gone = np.zeros(len(d), bool)
    gone[order] = least < d[order]
    out: tuple[list, list, list, list] = ([], [], [], [])
    at = 0
    for (doc, text_hash, first, _), n in zip(rows, sizes, strict=True):
        starts, lengths = _stretches(gone[at : at + n])
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            for column, x in zip(out, (doc, text_hash, first + s, m), strict=True):
                column.append(x)
        at += n
    return out


_RUNS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(doc, text_hash, first, n): stretches of windows whose words also start in a document of lesser id.

    ``docs`` is (doc, text_hash, text). First the minimisers alone are counted;
    super-k-mers leave their document only if another one has their minimiser.
    """
    heads = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("least", pa.int64()), ("windows", pa.int64())])

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(minimisers(word_hashes(_split(t.as_py())), window, run), return_counts=True) for t in batch.column(2)]
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f, _ in found])
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.concatenate([f for f, _ in found]).view(np.int64)), pa.array(np.concatenate([n for _, n in found]).astype(np.int64))], schema=heads)

    seen = staged(docs.mapInArrow(head, "doc long, text_hash long, least long, windows long"), "minimisers")
    spread = seen.groupBy("least").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.sum("windows").alias("n")).where("a < b")
    wanted = seen.join(spread.select("least", (F.col("n") > hot).alias("hot")), "least").groupBy(F.col("doc").alias("w_doc"), F.col("text_hash").alias("w_hash")).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("least"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("least"))).alias("warm"))
    sent = pa.schema([("least", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("other", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text, cold, warm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _split(text)
                hashes = word_hashes(words)
                least = minimisers(hashes, window, run)
                starts, sizes = super_kmers(least)
                of = least[starts].view(np.int64)
                for k in np.nonzero(np.isin(of, np.array(cold, np.int64)))[0].tolist():
                    rows.append((int(of[k]), doc, text_hash, int(starts[k]), b" ".join(words[starts[k] : starts[k] + sizes[k] + window - 1]), 0))
                if warm:
                    at = np.nonzero(np.isin(least.view(np.int64), np.array(warm, np.int64)))[0]
                    other = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))  # not of the same kind, so that words which collide in one differ in the other
                    one, two = (_runs(h, window, b)[at].view(np.int64).tolist() for h, b in zip((hashes, other), WORD_BASES, strict=True))
                    rows.extend((h, doc, text_hash, i, None, g) for h, i, g in zip(one, at.tolist(), two, strict=True))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    both = docs.join(wanted, (docs["doc"] == wanted["w_doc"]) & (docs["text_hash"] == wanted["w_hash"])).select("doc", "text_hash", "text", "cold", "warm")
    moved = both.mapInArrow(send, "least long, doc long, text_hash long, first long, words binary, other long")
    any_hot = not staged(spread.where(F.col("n") > hot).select("least"), "hot_minimisers").isEmpty()
    if any_hot:
        moved = staged(moved, "super_kmers")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for least, *row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if least != last and len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _judge(rows, window)], schema=_RUNS)
                    rows = []
                rows.append(row)
                last = least
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _judge(rows, window)], schema=_RUNS)

    bucketed = (moved.where("words is not null") if any_hot else moved).repartition("least").sortWithinPartitions("least")
    out = bucketed.mapInArrow(sort, "doc long, text_hash long, first long, n long")
    if any_hot:
        lone = moved.where("words is null").select("least", "other", "doc", "text_hash", "first")
        least_doc = lone.groupBy("least", "other").agg(F.min("doc").alias("least_doc"))
        out = out.unionByName(lone.join(least_doc, ["least", "other"]).where("least_doc < doc").select("doc", "text_hash", "first", F.lit(1).cast("long").alias("n")))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept if ``with_text``): one row for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a
    document of lesser doc_id. Words are taken as they are from whole texts; a null
    or short text keeps all it has. A null doc_id counts as greater than any other.
    Rows with one doc_id never take words from each other, and repeated rows come
    back each. kept is the remaining words, joined by spaces. An empty table gives
    no rows.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    found = repeated_windows(slim, window, run, hot).groupBy(F.col("doc").alias("f_doc"), F.col("text_hash").alias("f_hash")).agg(F.collect_set(F.struct("first", "n")).alias("found"))
    both = slim.join(found, (slim["doc"] == found["f_doc"]) & (slim["text_hash"] == found["f_hash"]), "left")
    out = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = _split(text.as_py())
                gone = 0
                kept = words
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [f["first"] for f in found], 1)
                    np.add.at(edge, [f["first"] + f["n"] + window - 1 for f in found], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    kept = list(compress(words, stays.tolist()))
                    gone = len(words) - len(kept)
                text_out = b" ".join(kept)
                rows.append((doc, len(words), gone, hashlib.sha256(text_out).hexdigest(), text_out.decode("utf-8", "surrogatepass") if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    done = both.select("doc", "text", "found").mapInArrow(cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    return done.withColumn("doc_id", F.nullif(F.col("doc"), F.lit(NO_ID))).select(*columns)


def op3_super_kmers(spark, sf_dir: str) -> DataFrame:
    """Query: words of every document, those removed, and a digest of the rest."""
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)
