"""Work that grows with the tables and not with their pairs; results as by the plain way."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from agentlens.functions import hashing
from agentlens.operators import attribution, incremental, outcomes
from agentlens.plans import events
from agentlens.sources import store_changes

DAY = datetime(2024, 1, 1)
BUDGET = "repo_root string, commit_sha string, rel_path string, line_hash string, budget bigint, commit_time timestamp"
SIGNAL = "repo_root string, rel_path string, line_hash string, count bigint, anchor_time timestamp, signal_time timestamp, signal_ref string, source string"


def plain(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_bugs_are_counted_as_pairs_would_be(spark, monkeypatch):
    rng = random.Random(3)
    at = lambda: DAY + timedelta(days=rng.randint(0, 90))
    budget = [("r", f"c{i}", rng.choice("fg"), f"h{rng.randint(0, 5)}", rng.randint(0, 2), t) for i in range(60) for t in [at()] for _ in range(rng.randint(1, 3))]
    signals = [("r", rng.choice("fg"), f"h{h}", 1, t, t if k % 4 else t + timedelta(days=1), f"s{k % 30}", rng.choice("xy")) for k in range(80) for t in [at()] for h in rng.choice([(0, 1, 2), (3,), (4, 5)])]
    # a line that 400 commits and 400 signals share
    hot = [("r", f"hot{i}", "hot", "h", 1, DAY + timedelta(hours=i)) for i in range(400)]
    told = [("r", "hot", "h", 1, DAY + timedelta(hours=3 * i), DAY + timedelta(hours=3 * i), f"s{i}", "x") for i in range(400)]
    b, s = spark.createDataFrame(budget + hot, BUDGET), spark.createDataFrame(signals + told, SIGNAL)
    want = plain(outcomes.bug_signals(outcomes.overlapping_signals(b, s)))
    paired, pairs = [], outcomes.overlapping_signals
    monkeypatch.setattr(outcomes, "overlapping_signals", lambda of, by: paired.append(of) or pairs(of, by))
    assert plain(outcomes.bugs_after(b, s)) == want and len(want) > 400
    assert paired[0].filter(F.col("rel_path") == "hot").count() == 0 < paired[0].count()


def test_a_version_is_compared_once(spark, monkeypatch):
    """However many sessions want it; sums against loops."""
    rng = random.Random(4)
    entries = [(rng.choice("pq"), i, rng.randint(0, 40), rng.choice(["Undo edit", "Edit"]), "\n".join(rng.choice("abc") for _ in range(4))) for i in range(60)]
    wanted = [(f"s{i}", rng.choice("pqr"), rng.randint(0, 40), rng.randint(0, 40)) for i in range(200)]
    want = {}
    for s, path, lo, hi in wanted:
        own = sorted((e for e in entries if e[0] == path), key=lambda e: (e[2], e[1]))
        for e, after in zip(own, [*own[1:], None]):
            if e[3].startswith("Undo") and lo <= e[2] <= hi:
                added, removed, _ = hashing.diff_counts(e[4], after[4] if after else "")
                one = want.setdefault((s, path), [0, 0])
                one[0], one[1] = one[0] + added, one[1] + removed
    compared, diff = [], store_changes.with_line_diff
    monkeypatch.setattr(store_changes, "with_line_diff", lambda df, *names: compared.append(df) or diff(df, *names))
    got = store_changes.history_lines(spark.createDataFrame(entries, "path string, id int, timestamp bigint, source string, content string"), spark.createDataFrame(wanted, "session_id string, path string, begin_ms bigint, end_ms bigint"))
    assert {(r["session_id"], r["path"]): [r["lines_added"], r["lines_removed"]] for r in got.collect()} == want
    assert compared[0].count() <= 60


LINE = "repo_root string, commit_sha string, rel_path string, side string, line_hash string, count bigint"
SESSION_LINE = "repo_root string, provider string, session_id string, rel_path string, side string, line_hash string, count bigint"


def lines_of_commits_and_sessions(spark, seed):
    rng = random.Random(seed)
    commits = [("r", f"c{i}", rng.choice("fg"), "+", h, rng.randint(1, 3)) for i in range(30) for h in [*rng.sample([f"h{k}" for k in range(12)], 3), "all"]]
    sessions = [("r", "codex", f"s{i}", rng.choice("fg"), "+", h, rng.randint(1, 2)) for i in range(20) for h in [*rng.sample([f"h{k}" for k in range(12)], 3), "all"]]
    return spark.createDataFrame(commits, LINE), spark.createDataFrame(sessions, SESSION_LINE)


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_shares_in_buckets_and_by_sums(spark, monkeypatch):
    """Few or many sessions in smaller classes, one or many buckets: the same shares, by the definition."""
    commits, sessions = lines_of_commits_and_sessions(spark, 5)
    have = {}
    for r in sessions.collect():
        key = (r["rel_path"], r["line_hash"])
        have.setdefault(key, {})[r["session_id"]] = max(r["count"], have.get(key, {}).get(r["session_id"], 0))
    want = {}
    for r in commits.collect():
        own = have.get((r["rel_path"], r["line_hash"]), {})
        want.setdefault((r["commit_sha"], r["rel_path"], r["line_hash"]), [0, own])[0] += r["count"]
    sums = {}
    for (sha, _, _), (n, own) in want.items():
        for s, avail in own.items():
            sums[sha, s] = sums.get((sha, s), 0) + min(n, sum(own.values())) * avail / sum(own.values())
    for few, pairs in ((256, 1 << 21), (0, 1 << 21), (3, 5), (256, 7)):
        monkeypatch.setattr(attribution, "FEW", few)
        monkeypatch.setattr(attribution, "BUCKET_PAIRS", pairs)
        shares = attribution.attributed(commits, sessions)[1].filter("provider <> 'human'").collect()
        assert {(r["commit_sha"], r["session_id"]): round(r["matched_lines"], 6) for r in shares} == {k: round(v, 6) for k, v in sums.items()} and len(shares) == len(sums)


def test_sessions_meet_the_next_commit_of_a_class(spark):
    """A line that all sessions and commits share gives a row for each session with a commit in time, not for each pair."""
    commits = spark.createDataFrame([("r", f"c{i}", "f", "+", "h", 1) for i in range(50)], LINE)
    times = spark.createDataFrame([("r", f"c{i}", DAY + timedelta(hours=i)) for i in range(50)], "repo_root string, commit_sha string, commit_time timestamp")
    sessions = spark.createDataFrame([("r", "codex", f"s{i}", "f", "+", "h", 1) for i in range(60)], SESSION_LINE)
    spans = spark.createDataFrame([("codex", f"s{i}", DAY + timedelta(hours=i - 5, minutes=30 * (i % 2)), DAY + timedelta(hours=i - 5)) for i in range(60)], "provider string, session_id string, _begin timestamp, _end timestamp")
    got = {r["session_id"]: r["commit_time"] for r in attribution.matches_within(commits, sessions, times, spans).collect()}
    want = {}
    for i in range(60):
        begin = i - 5 + (i % 2) / 2
        first = next((c for c in range(50) if c >= begin), None)
        if first is not None and first <= i - 5 + 4:
            want[f"s{i}"] = DAY + timedelta(hours=first)
    assert got == want and attribution.matches_within(commits, sessions, times, spans).count() == len(want)


def test_only_what_is_asked_for_is_computed(spark, monkeypatch):
    commits, sessions = lines_of_commits_and_sessions(spark, 6)
    listed = spark.createDataFrame([("r", f"c{i}", DAY + timedelta(days=i), "fix parser") for i in range(30)], "repo_root string, commit_sha string, commit_time timestamp, message string")
    made, classes = [], []
    for module in (attribution, outcomes, events, incremental):
        monkeypatch.setattr(module, "written", lambda df, old=module.written, **more: made.append(df) or old(df, **more))
    split = attribution.line_classes
    monkeypatch.setattr(attribution, "line_classes", lambda *a, **k: classes.append(a) or split(*a, **k))
    tables = events.commit_events(listed, commits, sessions, spark.createDataFrame([], "provider string, session_id string, model_name string"), listed, listed.filter("commit_sha = 'c3'"))
    assert tables["rejected"].count() == 1 and not made
    assert tables["outcome"].count() == tables["churn"].count() == 29 and made and not classes
    tables["bug"].count()
    assert not classes and tables["commit_session"].filter("commit_sha = 'c3'").count() == 0 and classes
    again = incremental.stale_commits(commits.select("repo_root", "commit_sha").distinct(), commits, sessions, sessions.filter("session_id <> 's1'"))
    lost = {r["line_hash"] for r in sessions.filter("session_id = 's1'").collect()}
    assert {r["commit_sha"] for r in again.collect()} == {r["commit_sha"] for r in commits.collect() if r["line_hash"] in lost}
    now = incremental.Reassociation(commits.select("repo_root", "commit_sha").distinct(), commits, sessions, sessions.filter("session_id <> 's1'"))
    del classes[:]
    assert rounded(now.facts(attribution.attributed(commits, sessions)[0])) == rounded(attribution.attributed(commits, sessions.filter("session_id <> 's1'"))[0])
    assert len(classes) == 2  # of the two full ones


def test_lines_that_nothing_removes_are_left_out_early(spark, monkeypatch):
    commits, sessions = lines_of_commits_and_sessions(spark, 7)
    times = commits.select("repo_root", "commit_sha", F.timestamp_seconds(F.substring("commit_sha", 2, 9).cast("int") * 86400).alias("commit_time")).distinct()
    removed = spark.createDataFrame([("r", "f", h, DAY.replace(year=1970) + timedelta(days=d), 1) for h in ("h1", "all") for d in (2, 9, 40)], "repo_root string, rel_path string, line_hash string, event_time timestamp, count bigint")
    timed = lambda *rows: attribution.ai_budget(*rows).join(times, ["repo_root", "commit_sha"])
    want = plain(outcomes.churn(timed(commits, sessions), removed, times))
    for most in (100_000, 1):
        monkeypatch.setattr(attribution, "MOST_LINES", most)
        few = attribution.on_lines(removed, commits, sessions)
        assert {r["line_hash"] for df in few for r in df.collect()} == {"h1", "all"}
        assert plain(outcomes.churn(timed(*few), removed, times)) == want and want
