"""Ranked search against the score of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from marlstone.llm import lexical as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    bags = [(doc, Counter(TERM.findall((text or "").translate(LOWER)))) for doc, text in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    N, L = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 10 + (90 * bag.total() * N) // L
            score = 0
            for t in {*TERM.findall((text or "").translate(LOWER))} & bag.keys():
                w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("heads", [1, 10])
def test_equals_all_scores(spark, words, monkeypatch, heads):
    monkeypatch.setattr(S, "HEADS", heads)
    monkeypatch.setattr(S, "LIST", 40)
    monkeypatch.setattr(S, "TERMS", 60)
    monkeypatch.setattr(S, "PART", 200)
    rng = random.Random(8)
    docs = [(i, words(rng.choice([3, 20, 150]), i % 260).title()) for i in range(300)]
    items = [(i, words(rng.choice([2, 12, 30]), 1000 + i) + (" " + docs[i][1] if i % 3 else "")) for i in range(25)]
    got = S.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert plain(got) == brute(docs, items, 4)


def test_thresholds_are_as_large_as_can_be(spark):
    rng = random.Random(5)
    rows = [(q, t, rng.choice([1, 3, 50, 10**12])) for q in range(30) for t in range(rng.randint(1, 6))]
    bounds = [(q, rng.randint(1, sum(top for p, _, top in rows if p == q))) for q in range(28)]
    got = S.thresholds(spark.createDataFrame(rows, "q long, term long, top long"), spark.createDataFrame(bounds, "q long, kth long")).collect()
    kth = dict(bounds)
    for r in got:
        tops = [top for q, _, top in rows if q == r["q"]]
        most = lambda least: sum(min(least - 1, top) for top in tops)
        assert r["rest"] == most(r["least"]) < kth.get(r["q"], 1) <= most(r["least"] + 1)
    assert len(got) == 30


def test_odd_rows(spark, odd):
    docs = [*enumerate(odd), (None, "x y"), (3, "x y"), (3, "x y"), (9, "NAÏVE naïve 漢字"), (10, "a\x00b_c{d}7")]
    items = [(1, "X 漢字 b"), (1, "X 漢字 b"), (None, "long c 7 zzz"), (2, None), (3, ""), (4, "--"), (5, "Naïve NAÏVE")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'z' AS term", "2 AS n")
    q = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "'z' AS q", "2 AS doc_id")
    assert plain(S.search(d, q)) == brute(docs, items)
    names = spark.createDataFrame([(str(i), t) for i, t in docs], "doc_id string, text string")
    assert plain(S.search(names, q)) == brute([(str(i), t) for i, t in docs], items)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        assert S.search(a, b).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, twin = S.op12_tput(spark, sf_dir), con.sql(S.ORACLE)
    assert sorted(twin.columns) == sorted(df.columns)
    assert plain(df) == sorted(twin.project("item_id, rank, doc_id, score").fetchall(), key=repr)
