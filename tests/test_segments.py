"""The data source of segments: round trips, pruning, commits, streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThan

from marlstone.sources.segments import commits, live, load, may_hold, publish, save


def test_round_trip_of_odd_rows(spark, tmp_path):
    stamp = datetime.datetime(2020, 1, 2, 3, 4, 5)
    rows = [(1, "a", 1.5, stamp, [1, 2]), (None, None, None, None, None), (2, "", float("nan"), stamp, []), (2, "", float("nan"), stamp, []), (-3, "é" * 100_000, float("inf"), stamp, None)]
    df = spark.createDataFrame(rows, "`path` long, s string, x double, at timestamp_ntz, xs array<int>").repartition(3)
    save(df, str(tmp_path))
    back = load(spark, str(tmp_path))
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    for where in ("`path` = 2", "x > 1", "s is null"):  # one DataFrame, several plans
        assert sorted(map(repr, back.where(where).collect())) == sorted(map(repr, df.where(where).collect())), where
    day = "timestamp_ntz'2020-01-02 03:04:05'"
    for given, where in [(("path", "=", 2), "`path` = 2"), (("path", "null"), "`path` is null"), (("path", "in", [1, -3, None]), "`path` in (1, -3)"), (("path", "<", 2), "`path` < 2"), (("path", "=", None), "false"),
                         (("s", "=", ""), "s = ''"), (("s", ">=", "b"), "s >= 'b'"), (("xs", "not null"), "xs is not null"), (("at", "=", stamp), f"at = {day}"), (("at", ">", stamp), f"at > {day}")]:
        assert sorted(map(repr, load(spark, str(tmp_path), given).collect())) == sorted(map(repr, df.where(where).collect())), where
    for wrong in (("x", ">", 1.0), ("nosuch", "=", 1), ("s", "like", "a")):
        with pytest.raises(Exception, match="filter"):
            load(spark, str(tmp_path), wrong).count()


def test_segments_out_of_range_are_not_opened(spark, tmp_path):
    save(spark.range(1000).repartitionByRange(4, "id"), str(tmp_path))
    for s in live(str(tmp_path)):
        if s["bounds"]["id"]["most"] < 700:
            os.unlink(tmp_path / "data" / s["file"])
    assert load(spark, str(tmp_path), ("id", ">=", 900)).count() == 100
    with pytest.raises(Exception, match="arrow"):
        load(spark, str(tmp_path)).count()


def test_bounds_rule_out_only_what_cannot_pass():
    s = {"rows": 5, "bounds": {"k": {"nulls": 1, "least": 3, "most": 9}, "n": {"nulls": 5}, "u": {"nulls": 0}}}
    assert [may_hold(s, f) for f in (EqualTo(("k",), 3), EqualTo(("k",), 10), GreaterThan(("k",), 9), LessThan(("k",), 4), In(("k",), (1, 9)), In(("k",), (1, None)))] == [True, False, False, True, True, False]
    assert [may_hold(s, f) for f in (IsNull(("k",)), IsNull(("u",)), IsNotNull(("n",)), EqualTo(("n",), 1), EqualTo(("u",), 1))] == [True, False, False, False, True]


def test_commits_append_overwrite_and_fail_whole(spark, tmp_path):
    path = str(tmp_path)
    save(spark.range(10), path)
    save(spark.range(0).where("id > 5"), path)
    save(spark.range(10, 20), path)
    assert load(spark, path).count() == 20 and commits(path) == [1, 2, 3]
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        save(broken, path)
    assert load(spark, path).count() == 20
    save(spark.range(5), path, mode="overwrite")
    assert load(spark, path).count() == 5
    assert publish(path, {"schema": spark.range(1).schema.json(), "overwrite": False, "segments": []}) == 5


def test_a_stream_gives_each_commit_once(spark, tmp_path):
    path, log, out = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "out")

    def go():
        rows = spark.readStream.format("marlstone_segments").load(path)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    save(spark.range(10).repartition(3), path)
    assert go() == list(range(10))
    save(spark.range(10, 15), path)
    assert go() == list(range(15)) and go() == list(range(15))
    save(spark.range(3), path, mode="overwrite")
    with pytest.raises(Exception, match="overwrote"):
        go()
