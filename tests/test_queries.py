"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from ferry.inputs import GIVEN
from tests.conftest import SMALL

SQL = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.CORPUS_RUNS}
QUERIES = {name: run for name, run in entry.queries().items() if name not in entry.CORPUS_RUNS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def spelled(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    found = sorted(tuple(map(spelled, r)) for r in df.select(*names).collect())
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    places = [columns.index(n) for n in names]
    assert found == sorted(tuple(spelled(r[i]) for i in places) for r in cursor.fetchall())


def test_flagship(spark):
    [row] = entry.entry(spark).collect()
    assert row.verified and row.row_count == 1500


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
