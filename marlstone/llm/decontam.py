"""Benchmark decontamination: BM25 over test items with block-max WAND, queried by every passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, ready, staged, table

#: Punctuation of ASCII reads as a space.
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
K1, B = 1.2, 0.75
#: Items of a block. A block of few items has a sum of maxima close to its best item's score.
BLOCK = 4
#: Cells of the table of passages by blocks that is filled at a time.
CELLS = 1 << 21


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """An item's words, cut where its last sentence or line of three words or more begins; else before its last quarter."""
    parts = [plain_words(x) for x in re.split(r"(?<=[.?!])\s+|\n+", (text or "").strip())]
    question, answer = [w for p in parts[:-1] for w in p], parts[-1]
    while len(answer) < 3 and len(parts) > 1:
        parts.pop()
        question, answer = [w for p in parts[:-1] for w in p], parts[-1] + answer
    if not question:
        cut = len(answer) - max(1, len(answer) // 4)
        question, answer = answer[:cut], answer[cut:]
    return question, answer


def shingles(words: list[bytes], n: int = 5) -> set[bytes]:
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings of test items by term, in blocks with their largest impacts.

    An impact is a term's BM25 share of its item's own score, so a score is the
    part of the item that a passage covers, from 0 to 1.
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int] | None = None, n_items: int | None = None, mean: float | None = None):
        self.ids, bags, self.parts = [], [], []
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
            if words := plain_words(text):
                self.ids.append(item_id)
                bags.append(Counter(words))
                q, a = question_answer(text)
                self.parts.append((shingles(q), shingles(a), min(5, len(q)), min(5, len(a))))
        if frequency is None:
            frequency = Counter(w for bag in bags for w in bag)
        n_items = n_items or len(bags)
        mean = mean or sum(sum(b.values()) for b in bags) / max(1, len(bags))
        self.longest = max([32, *(sum(b.values()) for b in bags)])
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for at, bag in enumerate(bags):
            size = sum(bag.values())
            raw = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for w, tf in bag.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                t = self.terms.setdefault(w, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((at, x / own))
        self.items = [[at for at, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_max = [{} for _ in postings]  # by number of the block: items are in blocks of BLOCK by place
        for best, items_, impacts in zip(self.block_max, self.items, self.impacts, strict=True):
            for at, x in zip(items_, impacts, strict=True):
                best[at // BLOCK] = max(x, best.get(at // BLOCK, 0.0))
        self.ceiling = [max(p) for p in self.impacts]
        self.n_blocks = max(1, -(-len(self.ids) // BLOCK))
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.block_max]))).astype(np.int64)
        self.block_of = np.array([k for b in self.block_max for k in b], np.int64)
        self.max_of = np.array([x for b in self.block_max for x in b.values()])

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items (place, score) that distinct ``terms`` cover to at least ``threshold``; block-max WAND."""
        found, at = [], {t: 0 for t in terms}
        slack = threshold - 1e-9
        live = list(terms)
        while live:
            live.sort(key=lambda t: self.items[t][at[t]])
            total, pivot = 0.0, -1
            for k, t in enumerate(live):
                total += self.ceiling[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.items[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.items[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            front = live[: pivot + 1]
            block = item // BLOCK
            bound = sum(self.block_max[t].get(block, 0.0) for t in front)
            if bound >= slack:
                score = 0.0
                for t in front:
                    k = bisect_left(self.items[t], item, at[t])
                    if k < len(self.items[t]) and self.items[t][k] == item:
                        score += self.impacts[t][k]
                        k += 1
                    at[t] = k
                if score >= slack:
                    found.append((item, score))
            else:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    to = min(to, self.items[live[pivot + 1]][at[live[pivot + 1]]])
                to = max(to, item + 1)
                for t in front:
                    at[t] = bisect_left(self.items[t], to, at[t])
            live = [t for t in live if at[t] < len(self.items[t])]
        return found

    def promising(self, ids: np.ndarray, threshold: float) -> list[int]:
        """Numbers of the passages in which some block's maxima, summed over the passage's distinct terms, reach ``threshold``.

        ``ids`` are the numbers of a text's words, -1 for words of no item. Passage k
        begins at word k * longest and has twice that many words. All passages and
        blocks are summed together; those left out can't hold an item above it.
        """
        step, out = self.longest, []
        n = max(1, -(-(len(ids) - step) // step))
        places = np.nonzero(ids >= 0)[0]
        half, terms = places // step, ids[places].astype(np.int64)
        size = len(self.items)
        pairs = np.unique(np.concatenate((half[half < n] * size + terms[half < n], (half[half > 0] - 1) * size + terms[half > 0])))
        rows, terms = np.divmod(pairs, size)
        many = max(1, CELLS // self.n_blocks)
        for first in range(0, n, many):
            a, b = np.searchsorted(rows, (first, first + many))
            t = terms[a:b]
            counts = self.offsets[t + 1] - self.offsets[t]
            at = np.repeat(self.offsets[t] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            cells = np.repeat((rows[a:b] - first) * self.n_blocks, counts) + self.block_of[at]
            here = min(many, n - first)
            best = np.bincount(cells, weights=self.max_of[at], minlength=here * self.n_blocks).reshape(here, self.n_blocks).max(1)
            out += (np.nonzero(best >= threshold - 1e-6)[0] + first).tolist()
        return out

    def search(self, text: str | None, threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage): the best passage for each item it holds.

        Passages are twice as long as the longest item and overlap by half, so each
        occurrence lies within one.
        """
        words = plain_words(text)
        if not words or not self.ids:
            return []
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int32, len(words))
        best: dict[int, tuple] = {}
        for k in self.promising(ids, threshold):
            a, b = k * self.longest, min((k + 2) * self.longest, len(words))
            for place, score in self.above([t for t in np.unique(ids[a:b]).tolist() if t >= 0], threshold):
                q, w, qn, wn = self.parts[place]
                here = {n: shingles(words[a:b], n) for n in {qn, wn} if n}
                got_q = len(q & here[qn]) / len(q) if q else 1.0
                got_a = len(w & here[wn]) / len(w) if w else 1.0
                if got_q >= question and got_a >= answer:
                    best[place] = max(best.get(place, ()), (round(score, 6), got_q, got_a, -a))
        return [(self.ids[p], s, q, w, -a) for p, (s, q, w, a) in sorted(best.items())]


#: An index holds items of at most so many bytes; more items are searched in several blocks.
ITEMS_BYTES = 32 << 20
#: Part of an item's BM25 mass that makes a candidate; parts of the five-word shingles of question and answer that verify it.
THRESHOLD, QUESTION, ANSWER = 0.6, 0.5, 0.5


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Callable[[], Index]]:
    """Makers of indexes over all items, one for each block of bounded size; document frequencies and lengths count all items."""
    slim = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size <= ITEMS_BYTES:
        return [lambda: Index([tuple(r) for r in slim.collect()])]
    n = -(-size // ITEMS_BYTES) * 2
    words = F.udf(lambda t: [w.decode("utf-8", "replace") for w in plain_words(t)], "array<string>", useArrow=True)
    split = staged(slim.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).withColumn("words", words("text")), "items")
    total = split.where(F.size("words") > 0).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    terms = split.select("block", F.explode(F.array_distinct("words")).alias("w"))
    df = staged(terms.groupBy("w").count(), "item_terms")

    def make(block: int) -> Index:
        own = {r["w"].encode(): r["count"] for r in terms.where(F.col("block") == block).select("w").distinct().join(df, "w").collect()}
        return Index([(r["item_id"], r["text"]) for r in split.where(F.col("block") == block).select("item_id", "text").collect()], own, total["n"], total["mean"])

    return [partial(make, block) for block in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start): one row for each document and test item that it holds.

    Every passage of every whole text queries the index. An item without words
    matches nothing, equal items match alike, a null or empty text holds none, and
    repeated rows give repeated results. Test items are collected in blocks of at
    most ITEMS_BYTES, so what is broadcast is bounded; documents are not shuffled.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage_start", pa.int64())])

    def found_in(sent) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in sent.value.search(text.as_py(), threshold, question, answer)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        return slim.mapInArrow(work, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long")

    makers = indexes(items)
    if len(makers) == 1:
        return found_in(docs.sparkSession.sparkContext.broadcast(makers[0]()))
    results = []
    for make in makers:  # one index at a time in the driver and the workers
        sent = docs.sparkSession.sparkContext.broadcast(make())
        results.append(staged(found_in(sent), "contaminated"))
        sent.destroy()
    return reduce(DataFrame.unionByName, results)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns.

    A null or empty text holds none. Repeated rows are judged alike; an empty table
    gives no rows. Items beyond one block are searched block by block, in what the
    blocks before left.
    """
    ready(docs.sparkSession)
    at = docs.columns.index("text")

    def kept_by(docs: DataFrame, sent) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.search(t.as_py(), threshold, question, answer) for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(work, docs.schema)

    makers = indexes(items)
    if len(makers) == 1:
        return kept_by(docs, docs.sparkSession.sparkContext.broadcast(makers[0]()))
    left = None
    for make in makers:
        sent = docs.sparkSession.sparkContext.broadcast(make())
        new = staged(kept_by(docs if left is None else left, sent), "uncontaminated")
        if left is not None:
            dropped(left)
        left = new
        sent.destroy()
    return left


def op9_bm25_block_max(spark, sf_dir: str) -> DataFrame:
    """Query: documents and the test items they hold."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"), "passage_start")
