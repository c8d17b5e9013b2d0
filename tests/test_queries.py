"""Every query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from timberline.plans import catalog

SMALL = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{name}')")
    return con


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SMALL)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    want = ordered(tuple(plain(r[columns.index(c)]) for c in found.columns) for r in cursor.fetchall())
    assert ordered(tuple(plain(v) for v in r) for r in found.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
