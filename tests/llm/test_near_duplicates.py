from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash
from marlstone.llm.graph import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_neighbours_share_keys():
    rng = np.random.default_rng(1)
    for width in (21, 22, 23):
        v = rng.integers(0, 1 << width, 4000)
        w = v ^ np.where(rng.random(4000) < 0.1, 0, 1 << rng.integers(0, width, 4000))
        near, all_v = simhash.codewords(v)[0], simhash.codewords(w)[1]
        assert (near[:, None] == all_v).any(1).all()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(rng, centres, copies):
    out = set()
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 62)) | int(rng.integers(0, 2)) << 63
        out.add(c)
        for _ in range(copies):
            x = c
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot", [1024, 3])
def test_links_lose_nothing(spark, hot):
    fps = planted(np.random.default_rng(2), 30, 8)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, hot=hot)).collect()}
    order = [signed(x) for x in fps]
    want = plain_components(order, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    groups = lambda roots: {frozenset(n for n in order if roots.get(n, n) == r) for r in {roots.get(n, n) for n in order}}
    assert groups(got) == groups(want)


def test_whole_query_equals_brute_force(make, words, odd):
    base = [words(80, s) for s in range(12)]
    texts = [*odd, *base, *base[:3], *[b.replace(" ", "\n", 3).upper() for b in base[:4]], *[b + " end" for b in base]]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make(texts)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_one_of_each_keeps_columns_and_ids(make, words, spark):
    a, b = words(90, 1), words(90, 2)
    docs = make([a, b, a, a + " x", None, ""]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("z"))
    kept = simhash.one_of_each(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
    return " ".join(w)


def jaccard(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_against_brute_force(make, words):
    """Of pairs with a similarity of 0.8 or more at most a twentieth is missed; none below it is linked."""
    from random import Random

    rng, texts, pairs = Random(1), [], []
    for s in range(150):
        n = (60, 120, 300, 900)[s % 4]
        a = words(n, 1000 + s)
        b = edited(rng, a, rng.randint(1, max(2, n // 35)))
        pairs.append((len(texts), len(texts) + 1, jaccard(a, b) >= 0.8))
        texts += [a, b]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(make(texts)).collect()}
    met = [got[a] == got[b] for a, b, close in pairs if close]
    assert len(met) > 70 and sum(met) >= 0.95 * len(met)
    assert not any(got[a] == got[b] for a, b, close in pairs if not close)


def test_a_large_group_is_one(make, words, monkeypatch):
    from random import Random

    monkeypatch.setattr(simhash, "PAIRED", 10)
    rng, hub = Random(2), words(200, 77)
    texts = [edited(rng, hub, 2) for _ in range(150)] + [hub] * 5 + [words(200, 78)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(make(texts)).collect()}
    assert len({got[i] for i in range(155)}) == 1 and got[155] == 155


@pytest.mark.parametrize("seed", [4, 5])
def test_crowded_keys_lose_no_link(make, words, monkeypatch, seed):
    """Variants of one text, most of which are similar to few others: groups are those of all pairs."""
    from random import Random

    monkeypatch.setattr(simhash, "PAIRED", 2)
    rng, hub = Random(seed), words(150, 70 + seed)
    texts = [edited(rng, hub, rng.randint(2, 4)) for _ in range(160)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(make(texts)).collect()}
    assert got == plain_components(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)


def test_near_misses_of_a_crowded_key_make_few_pairs(make, words, monkeypatch):
    """Variants of one text, most of them no more than near misses of each other: few are compared by their shingles, and no link is lost."""
    from random import Random

    made, linked = [], simhash._linked
    monkeypatch.setattr(simhash, "PAIRED", 2)
    monkeypatch.setattr(simhash, "_linked", lambda pairs, held, similarity: (made.append(pairs.count()), linked(pairs, held, similarity))[1])
    rng, hub = Random(9), words(150, 79)
    texts = [edited(rng, hub, rng.randint(2, 6)) for _ in range(120)]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(make(texts)).collect()}
    assert got == plain_components(range(len(texts)), lambda a, b: (max(a, b), min(a, b)) in near)
    assert len(made) == 2 and made[1] <= 3 * len(near) + 100, (made, len(near))


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 3000):
        held = np.unique(rng.integers(-(2**31), 2**31, n, dtype=np.int64)).astype(np.int32)
        other = np.unique(np.concatenate([held[n // 10 :], rng.integers(-(2**31), 2**31, n // 10, dtype=np.int64).astype(np.int32)]))
        bits = sum(int(x).bit_count() for x in (simhash.parities(held) ^ simhash.parities(other)).view(np.uint64))
        assert len(simhash.parities(held)) == simhash.PARITIES // 64 and bits <= len(np.setxor1d(held, other))
        assert n > 1000 or bits >= 0.8 * len(np.setxor1d(held, other))


def test_one_of_each_with_clashing_columns(make, words):
    clashing = ("dedup_id", "dedup_hash", "_kept_id", "kept_id", "kept_hash", "group", "component_id", "text_hash", "id", "fp")
    docs = make([words(90, 1), words(90, 1) + " x", None, ""]).select("*", *[F.lit(c).alias(c) for c in clashing])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_null_ids(spark, words):
    rows = spark.createDataFrame([(None, words(60, 1)), (5, words(60, 1)), (None, words(60, 2))], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def test_long_path_settles(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in components(edges).collect()} == {0}
