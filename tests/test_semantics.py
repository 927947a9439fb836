"""What stored data can't show: nulls, late rows, and laws between operators."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.operators import joins
from marlstone.operators.joins import as_of, range_join
from marlstone.plans.catalog import QUERIES
from marlstone.session import Tables
from marlstone.streaming import stateful
from marlstone.streaming.events import run, stream


def test_semi_and_anti_make_the_left_side(spark, sf_dir):
    t = Tables(spark, sf_dir)
    on = F.col("c_custkey") == F.col("o_custkey")
    parts = [t.customer.join(t.orders, on, kind).count() for kind in ("left_semi", "left_anti")]
    assert sum(parts) == t.customer.count()


def test_not_in_with_null(spark):
    assert spark.sql("SELECT x FROM VALUES (1), (2) v(x) WHERE x NOT IN (SELECT y FROM VALUES (1), (NULL) w(y))").count() == 0


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.sql("SELECT 9223372036854775807 + x FROM VALUES (1L) v(x)").collect()


@pytest.mark.parametrize("bucket", [None, 2])
def test_as_of_ties_and_nulls(spark, bucket):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 5, "d"), (1, None, "e"), (1, 8, "f")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, 50, 1), (1, 2, 20, 0), (1, 5, None, 2), (None, 1, 10, 0), (1, None, 30, 0)], "k int, t int, v int, at int")
    got = {r["name"]: r["v_as_of"] for r in as_of(left, right, "k", "t", "t", ["v"], bucket).collect()}
    assert got == {"a": 50, "b": None, "c": None, "d": None, "e": None, "f": 50}
    got = {r["name"]: r["v_as_of"] for r in as_of(left, right, "k", "t", "t", ["v"], bucket, tie=["at"]).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": None}


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).selectExpr("id", "cast(id * 1.7 as double) as x")
    ranges = spark.range(20).selectExpr("id as r", "cast(id * 13 as double) as low", "cast(id * 13 + id * 3 as double) as high")
    got = {(r["id"], r["r"]) for r in range_join(points, ranges, "x", "low", "high", 10.0).collect()}
    want = {(r["id"], r["r"]) for r in points.join(ranges, F.expr("x >= low and x < high")).collect()}
    assert got == want


def test_stream_keeps_only_the_last_window_open(spark, sf_dir):
    closed = QUERIES["stream_watermark"](spark, sf_dir).count()
    assert QUERIES["tumbling"](spark, sf_dir).select("start").distinct().count() == closed + 1


def test_late_row_is_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate([[0, 5, 60], [61], [1, 55, 62], [200]]):
        spark.createDataFrame([(start + dt.timedelta(minutes=m), m) for m in minutes], "ts timestamp, k int").coalesce(1).write.parquet(f"{tmp_path}/in/events{i}")
    files = spark.readStream.schema("ts timestamp, k int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = run(files.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n"))
    assert out.agg(F.sum("n")).first()[0] == 6  # minute 1 came too late, minute 200 is still open


def test_stream_reads_one_table(spark, sf_dir):
    assert stream(Tables(spark, sf_dir)).isStreaming


def test_a_table_that_is_written_anew_is_read_with_its_new_schema(spark, tmp_path):
    for columns in ("id", "id, id * 2 AS twice"):
        spark.sql(f"SELECT {columns} FROM range(3)").write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
        got = Tables(spark, str(tmp_path)).region
        assert got.columns == (["id"] if columns == "id" else ["id", "twice"])


def test_lateral_join_puts_nulls_last(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(None, 1, 5.0), (7, 1, 5.0), (8, 1, 5.0), (9, 1, None), (4, 2, None), (None, 2, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    twin = duckdb.connect()
    for name in ("customer", "orders"):
        twin.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["join_lateral"](spark, str(tmp_path)).collect()}
    assert got == set(twin.sql(QUERIES["join_lateral"].oracle).fetchall()) == {(1, 7), (2, None)}


def test_lateral_join_orders_the_rows_that_it_numbers(spark, sf_dir):
    """A sort before the shuffle binds nothing: executors fetch its blocks in any order, which a local session doesn't show."""
    plan = QUERIES["join_lateral"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    numbered = [x for x in plan.splitlines() if "row_number()" in x]
    assert numbered and all("o_totalprice" in x and "o_orderkey" in x for x in numbered)


def test_right_join_of_a_crowded_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 100)
    left = spark.createDataFrame([(i, None if i % 9 == 0 else i % 3) for i in range(60)], "a int, k int")
    right = spark.createDataFrame([(i, None if i % 7 == 0 else i % 4) for i in range(80)] * 2, "b int, j int")
    out = joins.right_join(left, right, "k", "j")
    want = left.join(right, F.col("k") == F.col("j"), "right")
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert max(out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < out.count() / 4


@pytest.mark.parametrize("name", ["stream_timer_sessions", "stream_expiring_state", "stream_analytic"])
def test_streams_of_users_that_share_a_call(spark, tmp_path, name):
    """Users of one group, of several, with negative ids and without one keep apart; a processor is called once for a group."""
    users, start = [None, -70, -1, 0, 1, 63, 64, 700], dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i + 40 * (i % 5)), users[i * i % 11 % 8], "abc"[i % 3], i / 4) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/rows")
    twin = duckdb.connect()
    twin.execute(f"copy (from '{tmp_path}/rows/*.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    twin.execute(f"create view events as from '{tmp_path}/events.parquet'")
    out = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, twin.sql(f"select {', '.join(out.columns)} from ({QUERIES[name].oracle})").fetchall()))
    assert stateful.USERS >= 64
