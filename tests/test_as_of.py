"""As-of joins whose hot keys are cut into spans found from the data."""

import random

import pytest

from marlstone.operators import joins as J


def brute(left, right):
    out = []
    for i, k, t in left:
        past = [(rt, rv) for rk, rt, rv in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        out.append((i, max(past, key=lambda p: (p[0], p[1] is not None, p[1] or 0))[1] if past else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span, keyed", [(1_000_000, 10), (40, 10), (3, 1), (40, 0)])
def test_spans_of_hot_keys_equal_brute_force(spark, monkeypatch, span, keyed):
    monkeypatch.setattr(J, "SPAN_ROWS", span)
    monkeypatch.setattr(J, "BROADCAST_ROWS", keyed)
    rng = random.Random(span + keyed)
    key = lambda: None if rng.random() < 0.05 else 7 if rng.random() < 0.4 else rng.randint(0, 12)
    time = lambda: None if rng.random() < 0.05 else rng.choice([3.0, float(rng.randint(-50, 50)), rng.random() * 1000])
    left = [(i, key(), time()) for i in range(400)]
    right = [(key(), time(), None if rng.random() < 0.1 else rng.randint(0, 99)) for _ in range(300)]
    a, b = spark.createDataFrame(left, "i long, k long, t double"), spark.createDataFrame(right, "k long, t double, v long")
    got = J.as_of(a, b, "k", "t", "t", ["v"]).select("i", "v_as_of").collect()
    assert sorted(map(tuple, got), key=repr) == brute(left, right)


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 1, 1.0)], "i long, k long, t double"), spark.createDataFrame([], "k long, t double, v long")
    assert [r["v_as_of"] for r in J.as_of(a, b, "k", "t", "t", ["v"]).collect()] == [None]
    assert J.as_of(a.limit(0), b, "k", "t", "t", ["v"]).count() == 0
