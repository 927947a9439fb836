"""Hard negatives against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from marlstone.llm import negatives as N


def brute(rows, every=100, positives=5, negatives=10, relabel=True):
    """Python's whole numbers, all pairs; rows are (vec_id, vector, label)."""
    kept = []
    for i, (vec_id, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if relabel and vec_id is not None and vec_id % 7 == 0 else label
        kept.append((i, vec_id, [math.floor(256 * float(np.float32(x))) for x in vec], label))
    late = lambda v: (v is None, v or 0)
    out = []
    for i, anchor, q, label in kept:
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), late(vec_id), vec_id, other) for j, vec_id, v, other in kept if j != i), key=lambda r: r[:2])
        for p, _, positive, _ in [r for r in scored if r[3] == label][:positives]:
            hard = [r for r in scored if r[3] != label and 30 * -p <= 100 * -r[0] <= 90 * -p][:negatives]
            out += [(anchor, positive, k + 1, r[2], -p, -r[0]) for k, r in enumerate(hard)]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("sizes", [(64, (2_000, 50_000)), (4, (10, 30))])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(N, "LEAF", sizes[0])
    monkeypatch.setattr(N, "TREE", sizes[1])
    monkeypatch.setattr(N, "BALLS", 3)
    monkeypatch.setattr(N, "BATCH", 5)
    monkeypatch.setattr(N, "SHARED", 7)
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i * 10, [x + rng.gauss(0, 0.3) for x in rng.choice(centers)], rng.randrange(10)) for i in range(400)]
    rows += [(5 * 10**9 + i, rows[0][1], rows[0][2]) for i in range(60)] + [(7 * 10**9, [0.0] * 6, 3)] * 3 + [(8 * 10**9 + i, rows[10][1], (rows[10][2] + 1 + i % 4) % 10) for i in range(40)]
    df = vectors(spark, rows)
    assert plain(N.hard_negatives(df, relabel=N.SHIFTED)) == brute(rows)
    assert plain(N.hard_negatives(df, every=70, positives=3, negatives=2)) == brute(rows, 70, 3, 2, relabel=False)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [0.5, 1.0], 2), (4, [0.5, 0.9], 2), (5, None, 1), (6, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2), (10, [1.0, 1.0], None), (11, [0.4], 2), (12, [], 2), (13, [0.5, 1.0, 4.0], 3), (200, [-1.0, -1.0, -1.0], 5), (-100, [0.3, 0.3], 2)]
    df = vectors(spark, rows).selectExpr("*", "'x' AS tree", "1 AS search", "2 AS vec")
    padded = [(i, None if v is None else [*v, 0.0, 0.0, 0.0][:3] if len(v) < 3 else v, y) for i, v, y in rows]
    assert plain(N.hard_negatives(df, relabel=N.SHIFTED)) == brute(padded)
    assert N.hard_negatives(df.limit(0)).count() == 0


def test_scores_beyond_double(spark):
    rows = [(0, [1e9, 1e9], 1), (1, [1e9, 1.0], 1), (2, [5e8, 77.0], 2)]
    a = N.inner(np.array([[2.0**38, 1.0]]), np.array([[2.0**20, 3.0]]))
    assert a.tolist() == [[2**58 + 3]]
    with pytest.raises(OverflowError):
        N.inner(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert plain(N.hard_negatives(vectors(spark, rows).where("vec_id > 0"), every=1)) == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    df = N.op11_ball_tree(spark, sf_dir)
    twin = con.sql(N.ORACLE)
    assert sorted(twin.columns) == sorted(df.columns)
    assert plain(df) == sorted(twin.project("anchor_id, positive_id, rank, negative_id, positive_score, negative_score").fetchall(), key=repr)
