"""Every query against its SQL twin, run by another engine on the same files."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from marlstone.plans.catalog import QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def twin(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_equals_twin(name, spark, sf_dir, twin):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = twin.sql(QUERIES[name].oracle)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
