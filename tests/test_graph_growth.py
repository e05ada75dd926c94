"""Chains that many tips share are told by their ends; what is listed is only the result."""

import random

from pyspark.sql import functions as F

from agentlens.operators import branches, commit_graph


def graph(spark, n, seed, straight):
    rng = random.Random(seed)
    parents = [("/r", str(i), str(p), k) for i in range(1, n) for k, p in enumerate([i - 1 if straight else rng.randint(max(0, i - 4), i - 1), *([rng.randint(0, i - 1)] if rng.random() < 0.2 else [])])]
    tips = [("/r", b, str(rng.randint(n // 3, n - 1))) for b in ("main", *(f"t{i}" for i in range(40)))]
    return spark.createDataFrame(tips, "repo_root string, branch string, commit_sha string"), spark.createDataFrame(parents, "repo_root string, commit_sha string, parent_sha string, parent_index int")


def test_owners_are_counted_without_chains(spark):
    tips, parents = graph(spark, 120, 1, False)
    listed = branches.owned(commit_graph.first_parent_chains(tips, parents).withColumn("on_first_parent", F.lit(1)))
    want = {(r["commit_sha"], r["n"], r["d"]) for r in listed.groupBy("commit_sha").agg(F.count("*").alias("n"), F.min("distance").alias("d")).collect()}
    assert want and {(r["commit_sha"], r["n_owners"], r["nearest"]) for r in commit_graph.owners(tips, parents, ("main",)).collect()} == want


def test_tables_are_smaller_than_what_is_listed(spark, monkeypatch):
    """300 commits in a line and 41 tips: no table has a row for each of a tip's commits."""
    tips, parents = graph(spark, 300, 2, True)
    made, keep = [], commit_graph.written
    monkeypatch.setattr(commit_graph, "written", lambda df, **more: made.append(df) or keep(df, **more))
    monkeypatch.setattr(commit_graph, "discarded", lambda *tables: None)
    monkeypatch.setattr(commit_graph, "BLOCK", 32)
    times = spark.range(300).select(F.lit("/r").alias("repo_root"), F.col("id").cast("string").alias("commit_sha"), F.timestamp_seconds(F.col("id") % 7).alias("commit_time"))
    held = commit_graph.branch_commits(tips, parents, times)
    rows = held.collect()
    assert max(df.count() for df in made) <= 41 * 10 < 5000 < len(rows)
    at = {str(i): (-(i % 7), str(i)) for i in range(300)}
    for branch in {r["branch"] for r in rows}:
        own = sorted((r for r in rows if r["branch"] == branch), key=lambda r: at[r["commit_sha"]])
        assert [r["distance"] for r in own] == list(range(len(own))) and all(r["on_first_parent"] == 1 for r in own)
