"""Every registered query against its SQL on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks.queries import QUERIES as PARITY_QUERIES
from checks.sql import SQL as PARITY_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(PARITY_SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    expected = duck.sql(entry_points.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [expected.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())
    assert mine == theirs and mine


def test_entry(spark):
    assert entry_points.entry(spark).count() == 30
    assert set(PARITY_SQL) == set(PARITY_QUERIES) <= set(entry_points.queries())
    assert PARITY_SQL.items() <= entry_points.oracle_sql().items()
