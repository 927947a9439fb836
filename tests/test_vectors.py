import random

import pytest

from marlstone.functions import vectors as V


def brute(queries, vectors, k):
    out = set()
    for q, x in queries:
        def product(y):
            total = 0.0
            for a, b in zip(x, y, strict=True):
                total += a * b
            return total
        ranked = sorted((-product(y), i) for i, y in vectors if i != q)
        out |= {(q, i) for _, i in ranked[:k]}
    return out


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    """Several blocks of queries and vectors, copies that tie, and negative products."""
    monkeypatch.setattr(V, "TOGETHER", 3)
    monkeypatch.setattr(V, "ROWS", 7)
    monkeypatch.setattr(V, "PAIRS", 5)
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(9)]) for i in range(60)]
    vectors += [(100 + i, vectors[i % 2][1]) for i in range(40)] + [(200, [0.0] * 9), (201, [-5.0] * 9)]
    queries = [r for r in vectors if r[0] % 10 == 0]
    got = V.nearest(spark.createDataFrame(queries, "query_id long, q array<double>"), spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4), 5, block)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(queries, vectors, 5)


def test_nearest_with_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(None, [1.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [9.0]), (8, [1.0, 2.0]), (9, [2.0, 1.0])]
    v = spark.createDataFrame([(*r, "x") for r in odd], "vec_id long, embedding array<float>, s string")
    q = spark.createDataFrame(odd, "query_id long, q array<float>")
    assert sorted(map(tuple, V.nearest(q, v, 3).collect())) == [(8, 9), (9, 8)]
    assert V.nearest(q.limit(0), v, 3).count() == 0 and V.nearest(q, v.limit(0), 3).count() == 0
