"""Every registered query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

from agentlens import queries as engine
from agentlens import source_queries  # noqa: F401  registers more of them

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_rows_equal_sql(spark, con, name):
    df = engine.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    told = con.sql(engine.SQL[name])
    assert sorted(told.columns) == names
    theirs = sorted((tuple(plain(dict(zip(told.columns, r))[c]) for c in names) for r in told.fetchall()), key=str)
    assert ours == theirs


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(engine.QUERIES) - set(engine.SQL)):
        assert engine.QUERIES[name](spark, DATA).count() > 0, name


def test_changed_multisets_read_all_events(spark):
    late = spark.range(60_000, 60_100).withColumnRenamed("id", "event_id")
    assert sorted(r["id"] for r in engine.changed_multisets(late).collect()) == sorted({i // 7 for i in range(60_000, 60_100) if i % 10 == 0})


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(engine.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
