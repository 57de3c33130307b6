"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from quantloom.plans import load
from quantloom.plans.catalog import QUERIES, SQL, near
from tests.conftest import SMALL

load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns) == _rows(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_near_rewrites_nested_calls():
    assert near("SELECT round(f(a, b), 2) AS x") == "SELECT (floor((f(a, b)) * 1e2 + 0.5000001) / 1e2) AS x"
