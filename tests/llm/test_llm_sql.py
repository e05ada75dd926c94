"""Operators that have SQL give its rows."""

import duckdb
import pytest

from agentlens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    told = con.sql(queries.SQL[name])
    names = sorted(told.columns)
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    theirs = sorted((tuple(dict(zip(told.columns, r))[c] for c in names) for r in told.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == theirs
