"""Refreshing event tables and associations, held against building them anew."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agentlens.operators import attribution, commit_graph, incremental
from agentlens.plans.refresh import EventStore

KINDS = "repo_root string, commit_sha string, commit_time timestamp_ntz, n int"
DAY = datetime(2026, 3, 2)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("repo_root", "commit_sha", "commit_time", "n").collect()), key=str)


def test_refresh_equals_build_and_survives_a_failure(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, KINDS)
    first = [("/r" if i % 3 else None, f"c{i}", DAY + timedelta(days=4 * i) if i % 7 else None, i) for i in range(20)]
    store = EventStore(spark, str(tmp_path))
    store.build("t", make(first), "commit_time")
    assert rows_of(store.read("t")) == rows_of(make(first))
    # some rows change, all rows of a week go, a week is new, and rows of no repository or time change
    second = [(r, c, t, n + 100 if n in (0, 3, 8) else n) for r, c, t, n in first if n != 5] + [("/new", "x", DAY, 1)]
    changed = [first[0], first[3], first[8], first[5], ("/new", "x", DAY, 1)]
    boom = F.udf(lambda n: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        store.refresh("t", make(second).withColumn("n", F.when(F.col("n") == 108, boom("n")).otherwise(F.col("n"))), "commit_time", make(changed))
    assert rows_of(store.read("t")) == rows_of(make(first))
    for _ in range(2):
        store.refresh("t", make(second), "commit_time", make(changed))
        assert rows_of(store.read("t")) == rows_of(make(second))
    store.refresh("t", make(first), "commit_time", make(changed))
    assert rows_of(store.read("t")) == rows_of(make(first))


def test_reassociation_equals_attribution(spark):
    rng = random.Random(6)
    line = lambda: f"h{int(60 * rng.random() ** 2)}"
    commits = [(f"/r{i % 2}", f"c{i}", f"p{rng.randint(0, 3)}", rng.choice("++-"), line(), rng.randint(1, 2)) for i in range(30) for _ in range(8)]
    old = [(f"/r{i % 2}", "a", f"s{i}", f"p{rng.randint(0, 3)}", rng.choice("++-"), line(), rng.randint(1, 3)) for i in range(12) for _ in range(8)]
    new = [r for r in old if r[2] != "s3"][:-2] + [("/r1", "a", "s12", "p1", "+", "h3", 2)]
    rows = spark.createDataFrame(commits, "repo_root string, commit_sha string, rel_path string, side string, line_hash string, count bigint")
    before, after = (spark.createDataFrame(x, "repo_root string, provider string, session_id string, rel_path string, side string, line_hash string, count bigint") for x in (old, new))
    facts, shares = attribution.attributed(rows.filter("commit_sha <> 'c7'"), before)
    got_facts, got_shares, again = incremental.reassociated(facts, shares, rows, before, after)
    full_facts, full_shares = attribution.attributed(rows, after)
    plain = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert plain(got_facts) == plain(full_facts) and plain(got_shares) == plain(full_shares)
    redone = {r["commit_sha"] for r in again.collect()}
    assert "c7" in redone and len(redone) < 30


def test_graph_of_merges(spark):
    """Ancestors and chains against walking the graph; merges of a line into another, over and over."""
    rng = random.Random(9)
    parents, of = [], {}
    for i in range(1, 120):
        own = [rng.randint(max(0, i - 5), i - 1)] + ([rng.randint(0, i - 1)] if rng.random() < 0.4 else [])
        of[i] = own
        parents += [("/r", str(i), str(p), k) for k, p in enumerate(own)]
    tips = [("/r", "main", "119"), ("/r", "side", "60"), ("/r", "root", "0"), ("/q", "main", "x")]
    edges = spark.createDataFrame(parents, "repo_root string, commit_sha string, parent_sha string, parent_index int")
    heads = spark.createDataFrame(tips, "repo_root string, branch string, commit_sha string")

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += of.get(x, [])
        return seen

    def chain(n):
        return [n] + (chain(of[n][0]) if n in of else [])

    want = {("main", str(x)) for x in reach(119)} | {("side", str(x)) for x in reach(60)} | {("root", "0"), ("main", "x")}
    assert {(r["branch"], r["commit_sha"]) for r in commit_graph.ancestors(heads, edges).collect()} == want
    lines = {(b, str(x), d) for b, t in (("main", 119), ("side", 60), ("root", 0)) for d, x in enumerate(chain(t))} | {("main", "x", 0)}
    assert {(r["branch"], r["commit_sha"], r["distance"]) for r in commit_graph.first_parent_chains(heads, edges).collect()} == lines
