"""Ranked lexical search by three phases over term-partitioned postings with one threshold for all lists (TPUT).

A document's score is a sum over the lists of an item's terms. (1) The head of every
list gives candidates; the exact scores of the best of them bound the k-th score from
beneath. (2) From that bound follows one threshold for all lists of an item: a document
that is above it in no list can't reach the k-th score. All entries above it are
fetched, and give each document a lower and an upper bound. (3) Documents whose upper
bound reaches the k-th best lower bound get their exact scores by look-up in a forward
table. All numbers are 64-bit integers, so ties are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded, dropped, numbered, ready, staged, table

#: Entries of a list's head, as a multiple of k; entries of a list's part.
HEADS, LIST = 10, 1_000_000
#: Distinct terms of all items that one pass over the documents looks for.
TERMS = 1_000_000
#: Bytes of a text whose terms are held at a time.
PART = 1 << 20
#: Separators become spaces and A-Z become a-z; bytes of characters beyond ASCII belong to terms.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a text in UTF-8, with its total as that of the counter."""
    folded, out, at = text.translate(FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(row, doc, n, terms, counts) of each row of ``docs`` (row, doc, text): its number of terms, and those of ``terms`` that it holds, by their place there, with their counts."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        for batch in batches:
            sizes, ends, found, counts = [], [0], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = terms_of(text or b"")
                sizes.append(own.total())
                some = [(places[t], c) for t, c in own.items() if t in places]
                found += [t for t, _ in some]
                counts += [c for _, c in some]
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.array(v, kind))) for v, kind in ((found, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *arrays], names=["row", "doc", "n", "terms", "counts"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("row", "doc", "text").mapInArrow(work, f"row long, doc {kind}, n long, terms array<int>, counts array<long>")


def asked_terms(items: DataFrame) -> DataFrame:
    """(q, word): the distinct terms of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = [t.decode() for t in terms_of(text or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(own), pa.int64()), pa.array(own, pa.string())], names=["q", "word"])

    return items.select("q", "text").mapInArrow(work, "q long, word string")


def impact(weight: Column, tf: Column, n: Column, documents: int, terms: int) -> Column:
    """What a term adds to the score of a document of ``n`` terms that holds it ``tf`` times."""
    length = F.lit(10).cast("long") + F.call_function("div", F.lit(90).cast("long") * n * F.lit(documents).cast("long"), F.lit(terms).cast("long"))
    return weight * F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * length)


class Index:
    """The postings of the terms that items ask for, each list in parts sorted by falling impact, and the forward table that they come from."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame):
        spark = docs.sparkSession
        self.key = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc"), "text")
        size, at, parts = vocabulary.count(), 0, []
        if size > TERMS:  # several passes, between which numbers of rows must not change
            rows = staged(rows, "rows")
        while at < size:
            words = [r["word"] for r in vocabulary.where(F.col("term").between(at, at + TERMS - 1)).orderBy("term").collect()]
            parts.append(staged(forward(rows, words).withColumn("first", F.lit(at).cast("long")), "forward"))
            at += TERMS
        self.documents, self.terms = parts[0].where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() if parts else (0, 0)
        if not self.documents:
            return
        self.forward, self.parts = parts[0], parts
        for part in parts[1:]:
            self.forward = self.forward.unionByName(part)
        entries = self.forward.select("row", "n", "first", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("row", "n", (F.col("first") + F.col("e.terms")).alias("term"), F.col("e.counts").alias("tf"))
        ratio = F.lit(float(2 * self.documents + 2)) / (2 * F.col("df") + 1).cast("double")
        self.weights = staged(entries.groupBy("term").agg(F.count("*").alias("df")).withColumn("weight", F.floor(F.log(ratio) * 1000)), "weights")
        scored = entries.join(bounded(self.weights), "term").withColumn("impact", impact(F.col("weight"), F.col("tf"), F.col("n"), self.documents, self.terms))
        part = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / LIST).cast("long"))
        scored = scored.where("impact > 0").select("term", part.alias("part"), "row", "impact")
        place = F.row_number().over(Window.partitionBy("term", "part").orderBy(F.desc("impact"), "row"))
        self.postings = staged(scored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "part").withColumn("place", place), "postings")

    def exact(self, pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """(q, row, doc, score) of pairs (q, row), looked up in the forward table."""
        rows = self.forward.join(bounded(pairs.select("row").distinct()), "row", "left_semi")
        held = pairs.join(rows, "row").select("q", "row", "doc", "n", "first", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        held = held.select("q", "row", "doc", "n", (F.col("first") + F.col("e.terms")).alias("term"), F.col("e.counts").alias("tf"))
        own = impact(F.col("weight"), F.col("tf"), F.col("n"), self.documents, self.terms)
        return held.join(bounded(lists.select("q", "term", "weight")), ["q", "term"]).groupBy("q", "row").agg(F.first("doc").alias("doc"), F.sum(own).alias("score"))

    def drop(self) -> None:
        """Delete the tables that no result reads any more."""
        dropped(self.weights, self.postings, *self.parts)


def first_of(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each item, ranked; each task keeps no more than ``k`` of an item before rows move."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def thresholds(lists: DataFrame, bounds: DataFrame) -> DataFrame:
    """(q, least, rest): the largest threshold of each item, and the most that a document can have that reaches it in no list.

    ``bounds`` (q, kth) has the bound of the k-th score. A list adds at most its
    greatest impact, so with lists in rising order of it the j least ones are counted
    whole: rest = sum of min(least - 1, top) stays beneath kth for the greatest of
    (kth - 1 - sum of j tops) div (lists left), over all j.
    """
    rising = Window.partitionBy("q").orderBy("top", "term")
    every = Window.partitionBy("q")
    whole = lists.join(bounds, "q", "left").withColumns({"kth": F.coalesce("kth", F.lit(1).cast("long")), "upto": F.sum("top").over(rising) - F.col("top"), "left": F.count("*").over(every) - F.row_number().over(rising) + 1})
    # the quotient is taken in whole numbers; doubles would round large ones
    level = F.max(F.when(F.col("kth") > F.col("upto"), F.call_function("div", F.col("kth") - 1 - F.col("upto"), F.col("left"))).otherwise(0)).over(every)
    return whole.withColumn("level", level).groupBy("q").agg((F.max("level") + 1).alias("least"), F.sum(F.least("level", "top")).alias("rest"), F.max("kth").alias("kth"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text), of those with a score above 0.

    Equal scores come by rising doc_id, rows without one last. A null or empty text
    has no terms: such documents aren't counted, such items get no rows. Repeated rows
    are documents, or items, each. Ids are of any type that has an order. A term that
    an item repeats counts once; a very long text is read in parts. Empty tables give no
    rows; other columns aren't read. A list of many entries is kept in parts by a hash
    of the row, so a word that every document holds is spread.
    """
    spark = docs.sparkSession
    ready(spark)
    queries = staged(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "items")
    asked = staged(asked_terms(queries), "asked")
    vocabulary = staged(numbered(asked.select("word").distinct(), F.col("word"), "term"), "vocabulary")
    index = Index(docs, vocabulary)
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {index.key}, score long"
    if not index.documents:
        return spark.createDataFrame([], kinds)
    tops = index.postings.groupBy("term").agg(F.max("impact").alias("top"))
    lists = staged(asked.join(vocabulary, "word").join(index.weights, "term").join(tops, "term").select("q", "term", "weight", "top"), "lists")

    # 1: the heads of all lists, and the exact scores of the best documents in them
    heads = index.postings.where(F.col("place") <= HEADS * k).join(bounded(lists.select("q", "term")), "term")
    seen = first_of(heads.groupBy("q", "row").agg(F.sum("impact").alias("sum")), k, F.desc("sum"), F.col("row"))
    known = index.exact(staged(seen.select("q", "row"), "seen"), lists)
    bounds = known.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select("q", "kth")
    limits = staged(thresholds(lists, bounds), "limits")

    # 2: all entries at or above their item's threshold, and what they say of each document
    wanted = lists.join(limits, "q").select("q", "term", "least", F.least(F.col("least") - 1, "top").alias("cap")).where("top >= least")
    fetched = index.postings.join(bounded(wanted), "term").where("impact >= least")
    sums = staged(fetched.groupBy("q", "row").agg(F.sum("impact").alias("sum"), F.sum("cap").alias("caps")), "sums")
    lower = first_of(sums.select("q", "row", "sum"), k, F.desc("sum"), F.col("row")).where(F.col("rank") == k).select("q", F.col("sum").alias("low"))
    reach = limits.join(lower, "q", "left").select("q", "rest", F.greatest("kth", F.coalesce("low", F.lit(1).cast("long"))).alias("bar"))
    alive = sums.join(bounded(reach), "q").where(F.col("sum") + F.col("rest") - F.col("caps") >= F.col("bar")).select("q", "row")

    # 3: exact scores of what is left
    scores = index.exact(staged(alive, "alive"), lists).where("score > 0")
    ranked = first_of(scores, k, F.desc("score"), F.asc_nulls_last("doc"), F.col("row"))
    out = staged(ranked.join(queries, "q").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked")
    index.drop()
    dropped(queries, asked, vocabulary, lists, limits, sums)
    return out


def op12_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the ten best documents for each item of the benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
