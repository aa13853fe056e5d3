"""Registered queries of the subpackage that SQL can express, against it."""

import duckdb
import pytest

from twinrun.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    expected = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    mine = sorted(repr([r[c] for c in columns]) for r in df.collect())
    at = [expected.columns.index(c) for c in columns]
    theirs = sorted(repr([r[i] for i in at]) for r in expected.fetchall())
    assert mine == theirs and mine
