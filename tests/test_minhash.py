"""Near-duplicates against all pairs, in crowded keys too."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import minhash as M
from marlstone.operators.graph import connected

PER_WORD = [f"w{i}" for i in range(3000)]


def sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(texts, threshold=0.8):
    own = sets(texts)
    return {(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and len(own[i] & own[j]) >= threshold * len(own[i] | own[j])}


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def corpus(rng, bases, copies, size, edits):
    out = []
    for _ in range(bases):
        base = rng.choices(PER_WORD, k=size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(size)] = rng.choice(PER_WORD)
            out.append(" ".join(w))
    return out


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("size, edits", [(8, 1), (40, 1), (300, 7)])
def test_recall_and_precision(spark, size, edits):
    texts = corpus(random.Random(size), 40, 4, size, edits)
    want = brute(texts)
    links, members = M.near_duplicates(make(spark, texts))
    named = {r["doc_id"]: r["set"] for r in members.collect()}
    got = {frozenset((r["a"], r["b"])) for r in links.collect()}
    pairs = {p for p in want if named[p[0]] == named[p[1]] or frozenset((named[p[0]], named[p[1]])) in got}
    assert len(pairs) >= 0.98 * len(want) and want
    true = {frozenset((named[a], named[b])) for a, b in want}
    assert got <= true


@pytest.mark.parametrize("few", [2, 8])
def test_many_groups_in_crowded_keys(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    rng = random.Random(few)
    shared = " ".join(rng.choices(PER_WORD, k=200))
    texts = [f"{shared} {t}" for t in corpus(rng, 25, 4, 300, 4)] + corpus(rng, 1, 60, 200, 2)
    want = groups(len(texts), brute(texts))
    got = {r["doc_id"]: r["group_id"] for r in M.near_duplicates(make(spark, texts))[1].collect()}
    linked = sum(1 for i, g in enumerate(want) if g != i)
    kept = sum(1 for i, g in enumerate(want) if g != i and got[i] == g)
    assert kept >= 0.9 * linked
    assert all(want[g] == want[i] for i, g in got.items())


def test_odd_rows(spark):
    texts = [None, "", " \n", "one", "one", "a b c d", "a b c d", "a b c d e", "x " * 70_000, "x " * 70_001, "naïve 漢字 \U0001f600 b c"]
    docs = make(spark, texts).selectExpr("*", "'z' AS set", "1 AS n", "2 AS key")
    got = {r["doc_id"]: (r["set"], r["group_id"]) for r in M.near_duplicates(docs)[1].collect()}
    assert [got[i][1] for i in range(11)] == [0, 1, 2, 3, 3, 5, 5, 7, 8, 8, 10]
    assert all((got[i][0] is None) == (i < 3) for i in range(11))
    some = spark.createDataFrame([("b", "q r s"), ("a", "q r s"), (None, "q r s"), ("a", "q r s")], "doc_id string, text string")
    assert [r["group_id"] for r in M.near_duplicates(some)[1].collect()] == ["a"] * 4
    links, members = M.near_duplicates(docs.limit(0))
    assert links.count() == members.count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(None, 3), (7, 7)]
    want = groups(500, [p for p in links if p[0] is not None])
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: want[n] for p in links if p[0] is not None for n in p}


def test_hashes_are_the_engine_s(spark):
    texts = ["", None, "one", "a b", " a\tb c\nd e f  g ", "x y " * 40, "é\u00a0ü a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.signed(df).join(df.select("doc_id", M.hashed(F.col("text"), 5).alias("h")), "doc_id").collect()}
    for i, text in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        runs = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        want = sorted(r[0] for r in spark.createDataFrame([(x,) for x in sorted(runs)], "s string").selectExpr("shiftrightunsigned(xxhash64(s), 4)").collect())
        assert got[i]["h"] == want and got[i]["n"] == len(want)
        assert got[i]["mins"] == [min(g) for _, g in itertools.groupby(want, lambda x: x >> 53)]
    assert str(M.signed(df).where("n > 0")._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
