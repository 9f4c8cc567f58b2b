"""Numbered queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from braggflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        path = f"{DATA}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    expect = sorted(repr([r[found.columns.index(c)] for c in columns]) for r in found.fetchall())
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == expect and len(got) > 0
