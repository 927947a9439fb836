"""Table functions: nulls, one partition, and arguments that are refused."""

import datetime as dt

import pytest

from marlstone.operators.udtfs import Decayed, Sessionise


@pytest.fixture
def view(spark):
    spark.udtf.register("sessionise", Sessionise)
    spark.udtf.register("decayed", Decayed)
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", 0, at(0), 4.0), ("a", 1, at(29), None), ("a", 2, at(59), 8.0), ("b", 3, None, None), ("b", 4, at(5), 1.0), (None, 5, at(7), 2.0)]
    spark.createDataFrame(rows, "k string, i int, at timestamp, v double").createOrReplaceTempView("visits")


def test_sessions(spark, view):
    got = spark.sql("SELECT i, session FROM sessionise(TABLE(visits) PARTITION BY k ORDER BY (at, i), 'at', 30)").collect()
    assert {r["i"]: r["session"] for r in got} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    assert spark.sql("SELECT * FROM sessionise(TABLE(SELECT * FROM visits WHERE i < 0) PARTITION BY k ORDER BY (at, i), 'at', 30)").count() == 0


def test_decayed(spark, view):
    got = spark.sql("SELECT i, decayed FROM decayed(TABLE(visits) PARTITION BY k ORDER BY (at, i), 'v')").collect()
    assert {r["i"]: r["decayed"] for r in got} == {0: 4.0, 1: 4.0, 2: 6.0, 3: None, 4: 1.0, 5: 2.0}


def test_arguments_are_checked(spark, view):
    with pytest.raises(Exception, match="names a column"):
        spark.sql("SELECT * FROM sessionise(TABLE(visits) PARTITION BY k ORDER BY (at, i), 'nothing', 30)").collect()
