"""Percentiles by selection against a sort."""

import math
import random

import numpy as np
import pytest

from marlstone.operators.selection import median, percentiles


def rows(spark, values, groups=None):
    groups = groups or [0] * len(values)
    return spark.createDataFrame(list(zip(groups, values, strict=True)), "g int, v double").repartition(5)


def spread(rng, n):
    return [rng.choice([rng.gauss(0, 1), rng.uniform(-1e300, 1e300), 10 ** rng.uniform(-300, 300), 5.0, 5.0, -1e-320]) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 10, 4096])
def test_equals_sorted_values(spark, few):
    rng = random.Random(few)
    data = {g: spread(rng, n) for g, n in ((1, 1), (2, 2), (3, 301), (None, 1000))}
    df = rows(spark, [v for vs in data.values() for v in vs], [g for g, vs in data.items() for _ in vs])
    at = {"lo": 0.0, "a": 0.013, "mid": 0.5, "b": 0.97, "hi": 1.0}
    for r in percentiles(df, ["g"], "v", at, few=few).collect():
        for c, p in at.items():
            assert r[c] == pytest.approx(float(np.quantile(np.array(data[r["g"]]), p)), rel=1e-12), (r["g"], c)
    for r in percentiles(df, ["g"], "v", at, interpolate=False, few=few).collect():
        for c, p in at.items():
            ordered = sorted(data[r["g"]])
            assert r[c] == ordered[max(0, math.ceil(p * len(ordered)) - 1)]


def test_two_values_of_many_copies(spark):
    df = rows(spark, [1.0] * 500 + [2.0] * 500)
    got = percentiles(df, [], "v", {"a": 0.5, "c": 0.51, "d": 0.1}, few=0).first()
    assert (got["a"], got["c"], got["d"]) == (1.5, 2.0, 1.0)


def test_nulls_nan_infinities(spark):
    inf, nan = math.inf, math.nan
    df = rows(spark, [1.0, None, 3.0, None, inf, -inf, 2.0, nan, inf, inf], [1, 1, 1, 2, 3, 3, 3, 4, 5, 5])
    got = {r["g"]: r["median"] for r in median(df, ["g"], "v").collect()}
    assert got[1] == 2.0 and got[2] is None and got[3] == 2.0 and math.isnan(got[4]) and got[5] == inf
    top = {r["g"]: r["m"] for r in percentiles(df, ["g"], "v", {"m": 1.0}, few=0).collect()}
    assert top[3] == inf and math.isnan(top[4])


def test_empty_and_clashing_names(spark):
    df = rows(spark, [1.0, 4.0]).withColumnRenamed("g", "_v").withColumnRenamed("v", "_low")
    assert median(df, ["_v"], "_low").first()["median"] == 2.5
    assert median(df.limit(0), ["_v"], "_low").count() == 0
