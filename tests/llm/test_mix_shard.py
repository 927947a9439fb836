from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing as M
from marlstone.llm import sharding as H
from marlstone.llm.common import numbered, repeated, row_hash


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        unit = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in left) if left else 0
        new = {s for s in left if w[s] * unit > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else w[s] * unit for s in names}
        full |= new


@pytest.fixture(scope="module")
def corpus(make, words, odd):
    texts = [*odd, *[words(10 + (i * 37) % 90, i) for i in range(900)]]
    sources = [None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(len(texts))]
    return make(texts, sources), texts, sources


def test_targets_and_taken(corpus):
    docs, texts, sources = corpus
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").encode().split())
    want = brute_targets(sizes)
    rows = {r["doc_id"]: r for r in M.mix(docs).collect()}
    assert len(rows) == len(texts)
    taken, longest = Counter(), Counter()
    for i, (t, s) in enumerate(zip(texts, sources, strict=True)):
        r = rows[i]
        assert r["size"] == len((t or "").encode().split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s]
        assert r["copies"] in (int(rate), int(rate) + 1)
        taken[s] += r["size"] * r["copies"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    assert sorted(M.mix(docs).collect()) == sorted(rows.values())


def test_expected_copies_are_kept(make, words):
    docs = make([words(20 + i % 7, i) for i in range(40)], ["a"] * 30 + ["b"] * 10)
    total, n = Counter(), 60
    for seed in range(n):
        for r in M.mix(docs.coalesce(1), share=0.6, seed=100 * seed).where("doc_id < 5").collect():
            total[r["doc_id"]] += r["copies"]
    rate = M.mix(docs, share=0.6).where("doc_id = 0").selectExpr("target / source_size").first()[0]
    for x in total.values():
        assert abs(x / n - rate) < 4 * (rate * (1 - rate) / n) ** 0.5


def test_mixed_rows(corpus):
    docs, texts, _ = corpus
    clashing = ("mix_key", "mix_other", "mix_size", "mix_rank", "taken_key", "_mixed_id", "_mixed_size", "copies", "target")
    wide = docs.select("*", *[F.lit(c).alias(c) for c in clashing])
    out = M.mixed(wide)
    assert out.columns == wide.columns
    got = Counter(r["doc_id"] for r in out.collect())
    want = {r["doc_id"]: r["copies"] for r in M.mix(wide, identity=row_hash(wide, 1)).withColumnRenamed("doc_id", "k").join(wide.select("doc_id", row_hash(wide, 1).alias("k")), "k").collect() if r["copies"]}
    assert got == want
    sizes, taken, longest = Counter(), Counter(), Counter()
    for i, (t, s) in enumerate(zip(texts, docs_sources(corpus), strict=True)):
        n = len((t or "").encode().split())
        sizes[s] += n
        taken[s] += n * got[i]
        longest[s] = max(longest[s], n)
    assert all(abs(taken[s] - x) <= longest[s] for s, x in brute_targets(sizes).items())
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(docs.drop("source")).count() == len(texts)


def docs_sources(corpus):
    return corpus[2]


def test_equal_rows_without_ids(spark):
    """A third of all rows is one row without an id: they are counted, spread over blocks, and come back as often as they are taken."""
    rows = [(None, "a b c", "s")] * 3000 + [(i, "d e", "t") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter((r["doc_id"] is None) for r in M.mixed(docs).collect())
    target = {r["source"]: r["target"] for r in M.targets(docs.selectExpr("source", "size(split(text, ' ')) as size")).collect()}
    assert abs(3 * taken[True] - target["s"]) <= 3 and abs(2 * taken[False] - target["t"]) <= 2
    out = H.sharded(docs, shards=4).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == 9000 and sum(r["doc_id"] is None for r in out) == 3000


def test_repeated_and_numbered(spark):
    df = spark.createDataFrame([("a", 3), ("b", 9001), ("c", 1)], "x string, n long")
    got = repeated(df, "n", "copy").groupBy("x").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect()
    assert {tuple(r) for r in got} == {("a", 3, 3, 3), ("b", 9001, 9001, 9001), ("c", 1, 1, 1)}
    many = spark.range(1000).select(F.when(F.col("id") > 0, F.concat(F.lit("s"), "id")).alias("s")).repartition(5)
    order = [r["s"] for r in numbered(many, F.col("s").asc_nulls_last(), "at").orderBy("at").collect()]
    assert order == [*sorted(f"s{i}" for i in range(1, 1000)), None]
    assert numbered(many.limit(0), F.col("s").asc(), "at").count() == 0


def test_shards_are_exact_and_gapless(corpus, monkeypatch):
    docs, texts, _ = corpus
    monkeypatch.setattr(H, "LOCAL_ROWS", 5)  # many blocks and parts
    wide = docs.select("*", *[F.lit(c).alias(c) for c in ("shard", "sh_key", "sh_rank", "_k1", "_k2", "k1", "copy")])
    out = H.sharded(wide, shards=7)
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    n = len(texts)
    assert sorted(len(v) for v in slots.values()) == sorted(n // 7 + (i < n % 7) for i in range(7))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in H.sharded(wide, shards=7).collect()} == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert H.sharded(wide.limit(0)).count() == 0


def test_repeated_rows_get_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows = H.sharded(docs, shards=5).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 53
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 5


def test_draws_are_hypergeometric(spark):
    n, good, picks, reps = 60, 20, 15, 4000
    rows = spark.range(reps).select(H._draw(F.lit(n).cast("long"), F.lit(good).cast("long"), F.lit(picks).cast("long"), H.unit(F.col("id"))).alias("x")).groupBy("x").count().collect()
    from math import comb

    got = {r["x"]: r["count"] for r in rows}
    chi, cells = 0.0, 0
    for k in range(picks + 1):
        want = reps * comb(good, k) * comb(n - good, picks - k) / comb(n, picks)
        if want > 10:
            chi += (got.get(k, 0) - want) ** 2 / want
            cells += 1
    assert chi < cells + 4 * (2 * cells) ** 0.5


def test_matrix_has_exact_margins(spark):
    counts = spark.createDataFrame([(0, 7), (1, 0), (2, 30), (3, 14)], "block long, n long")
    cells = {r["block"]: r["cells"] for r in H.matrix(counts, 2, 6, 3).collect()}
    assert {b: sum(c) for b, c in cells.items()} == {0: 7, 1: 0, 2: 30, 3: 14}
    assert [sum(c[s] for c in cells.values()) for s in range(6)] == [9, 9, 9, 8, 8, 8]
