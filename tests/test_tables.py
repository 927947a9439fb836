"""Versioned tables and MERGE: what the query twins don't show."""

import pytest
from pyspark.sql import functions as F

from marlstone.sources import tables
from marlstone.sources.tables import DuplicateMatch, MergeConflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"r{i}", i % 3) for i in range(100)] + [(None, "none", 0), (7, "again", 1)]
    return VersionedTable.create(spark.createDataFrame(rows, "k int, v string, g int"), f"file://{tmp_path}/t", ["k"], files=5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_untouched_files_stay(spark, table):
    before = {f["path"] for f in table.files}
    assert len(before) > 2
    source = spark.createDataFrame([(1, "new"), (500, "add")], "k int, v string")
    after = table.merge(source).update({"v": "s.v"}).insert({"k": "s.k", "v": "s.v"}).run()
    kept = before & {f["path"] for f in after.files}
    assert len(kept) == len(before) - 1
    got = rows(after.read())
    assert (1, "new", 1) in got and (500, "add", None) in got and len(got) == 103
    assert rows(table.read(0)) == rows(after.read(0)) and len(rows(after.read(0))) == 102
    assert after.versions() == [0, 1]


def test_nulls_match_nothing_and_a_source_row_may_match_many(spark, table):
    source = spark.createDataFrame([(None, "x"), (7, "seven")], "k int, v string")
    got = rows(table.merge(source).update({"v": "s.v"}).insert({"k": "s.k", "v": "s.v", "g": "9"}).run().read())
    assert [r for r in got if r[0] == 7] == [(7, "seven", 1), (7, "seven", 1)]
    assert sorted(r for r in got if r[0] is None) == [(None, "none", 0), (None, "x", 9)]


def test_duplicate_matches_raise_and_publish_nothing(spark, table):
    twice = spark.createDataFrame([(3, "a"), (3, "b")], "k int, v string")
    with pytest.raises(DuplicateMatch, match="3"):
        table.merge(twice).update({"v": "s.v"}).run()
    assert table.versions() == [0]
    unknown = spark.createDataFrame([(300, "a"), (300, "b"), (None, "c"), (None, "d")], "k int, v string")
    assert table.merge(unknown).insert({"k": "s.k", "v": "s.v"}).run().read().count() == 106


def test_first_clause_that_holds_applies_and_null_conditions_don_t(spark, table):
    source = spark.createDataFrame([(1, None), (2, 5), (4, 50)], "k int, x int")
    merged = table.merge(source).delete("s.x > 10").update({"v": "'small'", "g": "s.x"}, "s.x > 1").update({"v": "concat(t.v, '!')"}).run()
    got = {r["k"]: (r["v"], r["g"]) for r in merged.read().where("k in (1, 2, 4)").collect()}
    assert got == {1: ("r1!", 1), 2: ("small", 5)}


def test_the_second_of_two_writers_is_refused(spark, table):
    other = VersionedTable(spark, table.path)
    table.merge(spark.createDataFrame([(1, "a")], "k int, v string")).update({"v": "s.v"}).run()
    with pytest.raises(MergeConflict):
        other._publish(1, other.files)
    assert VersionedTable(spark, table.path).read().where("v = 'a'").count() == 1


def test_empty_source_and_empty_table(spark, table, tmp_path):
    nothing = spark.createDataFrame([], "k int, v string")
    assert rows(table.merge(nothing).update({"v": "s.v"}).insert({"k": "s.k"}).run().read()) == rows(table.read(0))
    bare = VersionedTable.create(spark.createDataFrame([], "k int, v string"), f"file://{tmp_path}/bare", ["k"])
    filled = bare.merge(spark.createDataFrame([(1, "a")], "k int, v string")).insert().run()
    assert rows(filled.read()) == [(1, "a")]


def test_keys_of_two_columns_and_odd_names(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 0)], "`k 1` string, t int, `s.x` int")
    table = VersionedTable.create(df, f"file://{tmp_path}/two", ["k 1", "t"])
    source = spark.createDataFrame([("a", 2, 8), ("c", 1, 9)], "`k 1` string, t int, y int")
    got = table.merge(source).update({"s.x": "s.y"}).insert({"k 1": "s.`k 1`", "t": "s.t", "s.x": "s.y"}).run().read()
    assert rows(got) == [("a", 1, 0), ("a", 2, 8), ("b", 1, 0), ("c", 1, 9)]


def test_a_merge_reads_only_keys_of_files_that_may_match(spark, table):
    source = spark.createDataFrame([(1, "new")], "k int, v string")
    near = table._overlapping(source)
    assert 0 < len(near) < len(table.files)
    plan = table._of(near).select("k", F.col("_metadata.file_path"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int>" in plan


def test_files_and_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 100)
    table = VersionedTable.create(spark.range(2000).selectExpr("id as k", "0 as g"), f"file://{tmp_path}/t", ["k"], files=2)
    after = table.merge(spark.range(1000, 3000).selectExpr("id as k")).update({"g": "1"}).insert({"k": "s.k", "g": "2"}).run()
    assert max(f["rows"] for f in table.files + after.files) < 300
    assert after.read().groupBy("g").count().orderBy("g").collect() == [(0, 1000), (1, 1000), (2, 1000)]
