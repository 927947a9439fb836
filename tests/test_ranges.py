"""Range and overlap joins against nested loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators.joins import overlap_join, range_join, range_totals
from marlstone.plans.catalog import QUERIES


def numbers(rng, n):
    return [rng.choice([rng.uniform(0, 100), rng.gauss(0, 1e9), rng.randrange(50), 10 ** rng.uniform(-30, 200), -1e308, 1e308]) * 1.0 for _ in range(n)]


@pytest.mark.parametrize("width", [None, 7.0])
def test_lengths_of_all_sizes(spark, width):
    rng = random.Random(3)
    p = [*enumerate(numbers(rng, 300)), (900, None), (901, math.nan), (902, math.inf)]
    r = [(i, a, rng.choice([a, a + 1e-9, a + 1, a + 1e5, abs(a) * 2, 1e308, math.inf])) for i, a in enumerate(numbers(rng, 150))]
    r += [(500, -math.inf, math.inf), (501, None, 4.0), (502, 4.0, None), (503, 9.0, 1.0), (504, -math.inf, -1e300)]
    want = {(i, j) for i, x in p for j, a, b in r if None not in (x, a, b) and not math.isnan(x) and a <= x < b}
    points = spark.createDataFrame(p, "id int, x double").repartition(3)
    ranges = spark.createDataFrame(r, "r int, a double, b double").withColumn("_cell", F.lit(1)).repartition(3)
    out = range_join(points, ranges, "x", "a", "b", width)
    got = [(q["id"], q["r"]) for q in out.select("id", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert range_join(points.limit(0), ranges, "x", "a", "b").count() == range_join(points, ranges.limit(0), "x", "a", "b").count() == 0


def test_a_long_range_makes_few_rows(spark):
    points = spark.range(1000).selectExpr("id", "cast(id as double) as x")
    ranges = spark.createDataFrame([(0, 0.0, 1e12), (1, 5.0, 5.5), (2, 900.0, 900.001)], "r int, a double, b double")
    out = range_join(points, ranges, "x", "a", "b")
    assert out.count() == 1000 + 1 + 1
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_equal_keys_and_overlaps(spark):
    rng = random.Random(6)
    make = lambda n: [(i, rng.randrange(4), a := rng.randrange(100), a + rng.choice([0, 1, 5, 80])) for i in range(n)]
    a, b = make(120), make(90)
    left, right = spark.createDataFrame(a, "i int, k int, a int, b int"), spark.createDataFrame(b, "j int, k int, c int, d int")
    want = {(i, j) for i, k, a_, b_ in a for j, m, c, d in b if k == m and a_ < d and c < b_ and a_ < b_ and c < d}
    got = [(r["i"], r["j"]) for r in overlap_join(left, right, ("a", "b"), ("c", "d"), on=["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_totals_form_no_pairs(spark):
    rng = random.Random(8)
    p = [(rng.randrange(40), rng.choice([None, i, -i, 1 << 40])) for i in range(400)] + [(None, 5), (41, None)]
    r = [(rng.randrange(30), a, a + rng.randrange(-3, 30)) for a in (rng.randrange(45) for _ in range(150))] + [(90, None, 4), (91, 4, None), (92, 60, 70), (None, 0, 50), (93, 41, 42)]
    want = {}
    for k, a, b in r:
        for x, v in p:
            if None not in (a, b, x) and a <= x < b:
                want.setdefault(k, []).append(v)
    points, ranges = spark.createDataFrame(p, "x int, v long").repartition(3), spark.createDataFrame(r, "k int, a int, b int").repartition(3)
    out = range_totals(points, ranges, "x", "a", "b", "v", ["k"])
    got = {q["k"]: (q["n"], q["total"]) for q in out.collect()}
    assert got == {k: (len(vs), sum(kept) if (kept := [v for v in vs if v is not None]) else None) for k, vs in want.items()}
    assert range_totals(points.limit(0), ranges, "x", "a", "b", "v", ["k"]).count() == range_totals(points, ranges.limit(0), "x", "a", "b", "v", ["k"]).count() == 0


def test_long_errors_over_many_purchases(spark, tmp_path):
    events = spark.range(40_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "0L as user_id", "if(id % 2 = 0, 'error', 'purchase') as event_type", "100d as value", "'' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["join_range_levels"](spark, str(tmp_path))  # 200 million pairs
    assert "_cell" not in out._jdf.queryExecution().toString()
    assert out.agg(F.sum("n"), F.max("n"), F.count("*")).first() == (20_000 * 20_001 // 2, 20_000, 20_000)
