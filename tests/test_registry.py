"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from braggflow.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLES:
        found = sql.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        assert rows == sorted(repr([plain(r[found.columns.index(c)]) for c in columns]) for r in found.fetchall())
