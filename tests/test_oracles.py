"""Every query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidegate.plans.catalog import QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in sorted(Path(data).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows(spark, data, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, data)
    want = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_gives_rows(spark, data, name):
    df = QUERIES[name][0](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
