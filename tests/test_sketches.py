"""Sketches, frequent items and fixed samples against exact figures."""

import hashlib
import random
from collections import Counter

from marlstone.operators import sketches as S


def test_merged_sketches_are_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice([None, rng.randrange(3000)]), rng.choice([None, float("nan"), rng.gauss(0, 1)])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day int, user int, v double")
    daily = S.sketched(df, ["day"], "user", "v")
    got = S.merged(daily, []).select("rows", S.distinct_estimate().alias("d"), S.quantile_estimate(0.5).alias("m")).first()
    users = {u for _, u, _ in rows if u is not None}
    values = sorted(v for _, _, v in rows if v is not None and v == v)
    assert got["rows"] == 20_000 and abs(got["d"] - len(users)) <= len(users) * S.DISTINCT_ERROR
    assert abs(sum(v <= got["m"] for v in values) / len(values) - 0.5) <= S.QUANTILE_ERROR
    nothing = S.sketched(df.where("v is null"), ["day"], "user", "v").select(S.quantile_estimate(0.5).alias("m")).collect()
    assert all(r["m"] is None for r in nothing)
    assert S.sketched(df.limit(0), ["day"], "user", "v").count() == 0


def test_frequent_items_with_a_hot_one_and_nulls(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice(["hot", None, f"x{rng.randrange(500)}", f"y{rng.randrange(9)}"])) for g in (1, 2, None) for _ in range(3000)]
    want = {(g, w, n) for (g, w), n in Counter(rows).items() if n > 3000 * 0.02}
    df = spark.createDataFrame(rows, "g int, `n x` string")
    assert {tuple(r) for r in S.frequent(df, "n x", 0.02, ["g"]).collect()} == want
    assert {tuple(r) for r in S.frequent(df, "n x", 0.1).collect()} == {(w, n) for w, n in Counter(w for _, w in rows).items() if n > 900}
    assert S.frequent(df.limit(0), "n x", 0.1).count() == 0


def number(*keys):
    return int(hashlib.md5("|".join(["s", *map(str, keys)]).encode()).hexdigest()[:13], 16)


def test_bottom_k_of_parts_merge_to_that_of_the_whole(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g").repartition(7)
    whole = {tuple(r) for r in S.bottom_k(df, 25, ["id"], ["g"], salt="s").collect()}
    assert whole == {(i, g) for g in range(3) for i in sorted(range(g, 1000, 3), key=number)[:25]}
    parts = S.bottom_k(df.where("id < 400"), 25, ["id"], ["g"], salt="s").union(S.bottom_k(df.where("id >= 400"), 25, ["id"], ["g"], salt="s"))
    assert {tuple(r) for r in S.bottom_k(parts, 25, ["id"], ["g"], salt="s").collect()} == whole


def test_priority_samples_are_unbiased(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1.0, 5.0, 400.0])) for i in range(600)] + [(900, None), (901, 0.0), (902, -3.0)]
    df = spark.createDataFrame(rows, "id int, w double")
    total, sums = sum(w for _, w in rows if w and w > 0), []
    for salt in range(12):
        got = S.bottom_k(df, 100, ["id"], weight="w", salt=str(salt)).collect()
        assert len(got) == 100 and all(r["w"] > 0 and r["priority"] > r["threshold"] for r in got)
        sums.append(sum(max(r["w"], r["threshold"]) for r in got))
    assert abs(sum(sums) / len(sums) / total - 1) < 0.05
    all_ = S.bottom_k(df, 10_000, ["id"], weight="w").collect()
    assert len(all_) == 600 and {r["threshold"] for r in all_} == {0.0}
