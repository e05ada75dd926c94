import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from agentlens.operators import attribution, branches, conversation, identity, incremental, outcomes
from agentlens.functions import hashing
from agentlens.sources import pull_files

LINE = "repo_root string, commit_sha string, rel_path string, side string, line_hash string, count bigint"
SESSION_LINE = "repo_root string, provider string, session_id string, rel_path string, side string, line_hash string, count bigint"
DAY = datetime(2026, 3, 1)


def test_debug_loop_and_paste(spark):
    texts = ["Please sort the columns", "ValueError: wrong shape of row 31", "same error", "still failing", "still failing, same error", "ValueError: wrong shape of row 77"]
    rows = [("c", "s", 2 * i + j, r, t) for i, u in enumerate(texts) for j, (r, t) in enumerate((("user", u), ("assistant", "try again")))]
    rows += [("c", "none", 0, "assistant", "hello"), ("c", "blank", 0, "user", "  ")]
    got = conversation.summaries(spark.createDataFrame(rows, "provider string, session_id string, message_index bigint, role string, content string")).collect()
    assert [(r["session_id"], r["user_turn_count"], r["debug_loop_flag"], r["mid_session_error_paste_flag"]) for r in got] == [("s", 6, 1, 1)]


def fold_debug_loop(turns):
    """The same rule, turn by turn."""
    counts, previous = {}, None
    for text, own, cont in turns:
        signature = previous if cont and previous else own
        if signature is not None:
            counts[signature] = counts.get(signature, 0) + 1
        previous = signature
    return int(max(counts.values(), default=0) >= 5)


def test_debug_loop_equals_fold(spark):
    random.seed(4)
    own = {"error: a": "error: a", "panic b": "panic b", "hello": None, "same error": None, "still failing error: a": "still failing error: a"}
    rows, want = [], {}
    for s in range(60):
        turns = [random.choice(list(own)) for _ in range(random.randint(1, 14))]
        want[str(s)] = fold_debug_loop([(t, own[t] if t != "same error" else ("same error" if False else None), "same error" in t or "still failing" in t) for t in turns])
        rows += [("c", str(s), 2 * i + j, r, t) for i, u in enumerate(turns) for j, (r, t) in enumerate((("user", u), ("assistant", "x")))]
    # "same error" has the keyword " error " itself, so alone it is its own signature
    own["same error"] = "same error"
    for s in want:
        turns = [r[4] for r in rows if r[1] == s and r[3] == "user"]
        want[s] = fold_debug_loop([(t, own[t], "same error" in t or "still failing" in t) for t in turns])
    got = conversation.summaries(spark.createDataFrame(rows, "provider string, session_id string, message_index bigint, role string, content string")).collect()
    assert {r["session_id"]: r["debug_loop_flag"] for r in got} == want


def attribute(commit, sessions):
    """Attribution by loops, for one commit of one repository."""
    avail, one = {}, {}
    for _, p, s, path, side, h, n in sessions:
        avail.setdefault((path, side, h), {})[(p, s)] = max(n, avail.get((path, side, h), {}).get((p, s), 0))
        one[(path, side, h)] = max(n, one.get((path, side, h), 0))

    def match(path, rows):
        out = {}
        for (side, h), n in rows.items():
            have = avail.get((path, side, h), {})
            total = sum(have.values())
            for k, a in have.items():
                out[k] = out.get(k, 0) + min(n, total) * a / total
        return round(sum(out.values()), 6), out

    def pick(cands, total):
        cands = sorted(cands, key=lambda c: (-c[1], c[0]))
        if cands and cands[0][1] >= 30 and cands[0][1] / total >= 0.8 and cands[0][1] / total - (cands[1][1] if len(cands) > 1 else 0) / total >= 0.2:
            return cands[0][0]

    result = {}
    for path in {r[2] for r in commit}:
        rows = {}
        for _, _, p, side, h, n in commit:
            if p == path:
                rows[(side, h)] = rows.get((side, h), 0) + n
        total = sum(rows.values())
        best = match(path, rows)
        if best[0] / total < 0.2:
            score = {}
            for (side, h), n in rows.items():
                for (p, s2, h2), a in one.items():
                    if (s2, h2) == (side, h) and p != path:
                        score[p] = score.get(p, 0) + min(n, a)
            base = path.rsplit("/", 1)[-1]
            alias = pick([c for c in score.items() if c[0].rsplit("/", 1)[-1] == base], total) or pick(list(score.items()), total)
            if alias and match(alias, rows)[0] > best[0]:
                best = match(alias, rows)
        for k, v in best[1].items():
            result[k] = result.get(k, 0) + v
    return result


def test_attribution_equals_loops(spark):
    random.seed(2)
    commits, sessions = [], []
    for k in range(40):
        lines = [f"h{k}-{i}" if random.random() < 0.8 else f"h{random.randint(0, 5)}" for i in range(40)]
        name = random.choice(["a.py", "b.py"])
        commits += [("r", f"c{k}", random.choice([f"old/{name}", f"new/{name}"]), "+", h, random.randint(1, 2)) for h in lines[: random.choice([10, 40])]]
        for s in range(random.randint(0, 2)):
            sessions += [("r", "codex", f"s{s}", f"old/{random.choice([name, 'z.py'])}", "+", h, random.randint(1, 3)) for h in lines[: random.randint(1, 40)]]
    facts, shares = attribution.attributed(spark.createDataFrame(commits, LINE), spark.createDataFrame(sessions, SESSION_LINE))
    got = {}
    for r in shares.collect():
        got.setdefault(r["commit_sha"], {})[(r["provider"], r["session_id"])] = round(r["matched_lines"], 5)
    for k in range(40):
        want = {a: round(b, 5) for a, b in attribute([c for c in commits if c[1] == f"c{k}"], sessions).items()} or {("human", "__human__"): 0.0}
        assert got[f"c{k}"] == want
    assert facts.count() == 40


def test_nothing_matches_and_half_matches(spark):
    commit = spark.createDataFrame([("r", "c", "f", "+", "h", 10)], LINE)
    facts, shares = attribution.attributed(commit, spark.createDataFrame([], SESSION_LINE))
    assert [(r["provider"], r["share_of_commit"], r["share_of_ai"]) for r in shares.collect()] == [("human", 1.0, 0.0)] and facts.first()["heavy_ai"] == 0
    facts, shares = attribution.attributed(commit, spark.createDataFrame([("r", "codex", "s", "f", "+", "h", 4)], SESSION_LINE))
    assert [(r["provider"], r["matched_lines"]) for r in shares.collect()] == [("codex", 4.0)] and facts.first()["matched_total_lines"] == 4


def test_budget_sums_providers(spark):
    commit = spark.createDataFrame([("r", "c", "f", "+", "h1", 3), ("r", "c", "f", "+", "h2", 2)], LINE)
    sessions = [("r", p, s, "f", "+", h, n) for p, s, h, n in (("codex", "s1", "h1", 5), ("codex", "s1", "h2", 1), ("cursor", "s2", "h1", 2), ("cursor", "s3", "h1", 1), ("cursor", "s3", "h2", 4))]
    have = attribution.provider_availability(spark.createDataFrame(sessions, SESSION_LINE))
    assert {r["line_hash"]: r["avail"] for r in have.collect()} == {"h1": 7, "h2": 5}
    assert {r["line_hash"]: r["budget"] for r in attribution.ai_budget(commit, spark.createDataFrame(sessions, SESSION_LINE)).collect()} == {"h1": 3, "h2": 2}


def test_commit_outcomes(spark):
    at = lambda d: DAY + timedelta(days=d)
    budget = spark.createDataFrame([("r", "a", "f", "h1", 20, at(0)), ("r", "a", "f", "h2", 15, at(0)), ("r", "b", "f", "h1", 20, at(4))], "repo_root string, commit_sha string, rel_path string, line_hash string, budget bigint, commit_time timestamp")
    commits = spark.createDataFrame([("r", "a", at(0)), ("r", "b", at(4))], "repo_root string, commit_sha string, commit_time timestamp")
    event = "repo_root string, rel_path string, line_hash string, event_time timestamp, count bigint"
    added = spark.createDataFrame([("r", "f", "h1", at(5), 20), ("r", "f", "h2", at(5), 15)], event)
    removed = spark.createDataFrame([("r", "f", "h1", at(6), 10), ("r", "f", "h2", at(9), 15), ("r", "f", "h1", at(19), 5)], event)
    reverts = spark.createDataFrame([("r", "a", at(7))], "repo_root string, commit_sha string, reverted_at timestamp")
    out = outcomes.outcomes(commits, budget, added, commits.filter("commit_sha = 'b'"), reverts)
    got = {r["commit_sha"]: (r["merged_to_mainline_flag"], r["reverted_later_flag"], r["ai_added_lines_reaching_mainline"]) for r in out.collect()}
    assert got == {"a": (1, 1, 35), "b": (1, 0, 20)}
    lost = outcomes.churn(budget, removed, out.filter("merged_to_mainline_flag = 1"))
    assert {r["commit_sha"]: r["ai_added_lines_removed_within_window"] for r in lost.collect()} == {"a": 25, "b": 10}


def test_content_in_a_renamed_file(spark):
    budget = spark.createDataFrame([("r", "a", "old/x.py", f"h{i}", 1, DAY) for i in range(40)], "repo_root string, commit_sha string, rel_path string, line_hash string, budget bigint, commit_time timestamp")
    added = spark.createDataFrame([("r", "new/x.py", f"h{i}", DAY + timedelta(days=1), 1) for i in range(36)], "repo_root string, rel_path string, line_hash string, event_time timestamp, count bigint")
    assert outcomes.content_merged(budget, added).count() == 1
    assert outcomes.content_merged(budget, added.withColumn("event_time", F.lit(DAY - timedelta(days=1)))).count() == 0


def test_bug_windows(spark):
    budget = spark.createDataFrame([("r", "a", "f", "h", 2, DAY)], "repo_root string, commit_sha string, rel_path string, line_hash string, budget bigint, commit_time timestamp")
    times = [0, 1, 60, 61]
    signals = spark.createDataFrame([("r", "f", "h", 1, DAY + timedelta(days=d), DAY + timedelta(days=d), f"s{d}", "git_fix_commit" if d else "x") for d in times], "repo_root string, rel_path string, line_hash string, count bigint, anchor_time timestamp, signal_time timestamp, signal_ref string, source string")
    (r,) = outcomes.bug_signals(outcomes.overlapping_signals(budget, signals)).collect()
    assert (r["bug_signal_count"], r["first_bug_signal_commit_sha"], r["signal_source"]) == (2, "s1", "git_fix_commit")


def test_branches(spark):
    rows = [("PAC-1-x", "c1", 1, 1), ("z", "c1", 2, 1), ("main", "c2", 5, 1), ("topic", "c2", 0, 1), ("develop", "c3", 0, 0), ("main", "c3", 3, 0), ("lost", "c4", 0, 0)]
    bc = spark.createDataFrame([("r", *x) for x in rows], "repo_root string, branch string, commit_sha string, distance bigint, on_first_parent int")
    commits = spark.createDataFrame([("r", f"c{i}") for i in range(1, 5)], "repo_root string, commit_sha string")
    got = {r["commit_sha"]: (r["branch_name"], r["task_key"], r["is_fallback"], r["confidence"]) for r in branches.assigned(commits, bc).collect()}
    assert got == {"c1": ("PAC-1-x", "PAC-1", 0, 0.75), "c2": ("main", "main", 1, 0.5), "c3": ("main", "main", 1, 0.5), "c4": ("(unknown)", "(unknown)", 1, 0.0)}


def test_pull_requests(spark):
    pulls = spark.createDataFrame([("k", "c", 5, None), ("k", "c", 9, DAY), ("k", "c", 7, DAY)], "repo_key string, commit_sha string, pr_number int, created_at timestamp")
    assert outcomes.owning_pull(pulls).first()["owning_pr_number"] == 7
    links = spark.createDataFrame([("k", 1, 2, 0, None), ("k", 1, 2, 1, DAY), ("k", 1, 2, 2, DAY + timedelta(days=1))], "repo_key string, issue_number int, pr_number int, position int, linked_at timestamp")
    assert outcomes.first_links(links).first()["linked_at"] == DAY


def test_incremental(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, mtime bigint, size bigint")
    cursors = spark.createDataFrame([("p1", "a", 1, 1), ("p2", "b", 2, 2)], "provider string, source_file string, file_mtime bigint, file_size bigint")
    todo = incremental.changed_files(files, cursors, "p1")
    assert [r["path"] for r in todo.collect()] == ["b"]
    again = incremental.advanced_cursors(cursors, todo, "p1")
    assert incremental.changed_files(files, again, "p1").count() == 0 and again.count() == 3
    old = spark.createDataFrame([(1, "r", "+", "x", 1), (2, "r", "+", "y", 1)], "id int, repo_root string, side string, line_hash string, count bigint")
    new = spark.createDataFrame([(1, "r", "+", "x", 1), (2, "r", "+", "z", 1)], "id int, repo_root string, side string, line_hash string, count bigint")
    assert {r["line_hash"] for r in incremental.dirty_hashes(old, new, ["id"]).collect()} == {"y", "z"}
    assert hashing.differs(old, old, ["id"], ["line_hash"]).count() == 0
    known = spark.createDataFrame([("c", "s", 4)], "provider string, session_id string, change_index bigint")
    more = spark.createDataFrame([("c", "s", 1, DAY), ("c", "s", 2, DAY), ("c", "t", 1, DAY)], "provider string, session_id string, change_id int, change_ts timestamp")
    assert sorted((r["session_id"], r["change_index"]) for r in incremental.running_index(more, known).collect()) == [("s", 5), ("s", 6), ("t", 0)]


def test_issue_linked_signals(spark):
    files = spark.createDataFrame([("k", 1, "a.py", None, "modified", "@@\n-x\n-x\n+y\n--- z"), ("k", 1, "new.py", "old.py", "renamed", "-q"), ("k", 2, "b.py", None, "modified", None), ("k", 3, "c.py", None, "added", None)],
        "repo_key string, pr_number int, filename string, previous_filename string, status string, patch string")
    hashes, complete = pull_files.removed_hashes(files)
    assert sorted((r["rel_path"], r["count"]) for r in hashes.collect()) == [("a.py", 2), ("old.py", 1)]
    assert {r["pr_number"]: r["removed_hashes_complete_flag"] for r in complete.collect()} == {1: 1, 2: 0, 3: 1}
    issues = spark.createDataFrame([("k", 7, 1, 0), ("k", 8, 0, 0), ("k", 9, 1, 1)], "repo_key string, issue_number int, bug_candidate_flag int, is_pull_request_flag int")
    links = spark.createDataFrame([("k", i, 1) for i in (7, 8, 9)], "repo_key string, issue_number int, pr_number int")
    pulls = complete.withColumn("repo_root", F.lit("r")).withColumn("merged_at", F.lit(DAY + timedelta(days=5)))
    signals = outcomes.issue_signals(issues, links, pulls, hashes)
    line = signals.filter("rel_path = 'a.py'").first()
    budget = spark.createDataFrame([("r", "c", "a.py", line["line_hash"], 1, DAY)], "repo_root string, commit_sha string, rel_path string, line_hash string, budget bigint, commit_time timestamp")
    (r,) = outcomes.bug_signals(outcomes.overlapping_signals(budget, signals)).collect()
    assert (r["first_bug_signal_commit_sha"], r["bug_signal_count"], r["signal_source"]) == ("issue#7/pr#1", 1, "github_issue_fix_pr_exact_hash")


def test_members_and_devices(spark):
    rows = spark.createDataFrame([(1, "/r"), (2, " /r "), (3, None), (4, " "), (5, "/other"), (6, "/blank")], "k int, repo_root string")
    emails = spark.createDataFrame([("/r", "b@x"), ("/r", "a@x"), ("/blank", " "), (None, "n@x")], "repo_root string, email string")
    of = lambda everywhere: {r["k"]: r["member_email"] for r in identity.with_member(rows, emails, everywhere).collect()}
    assert of("g@x") == {1: "a@x", 2: "a@x", 3: "g@x", 4: "g@x", 5: "g@x", 6: "g@x"}
    assert of(None) == {1: "a@x", 2: "a@x"} | dict.fromkeys((3, 4, 5, 6), "(unknown)")
    devices = spark.createDataFrame([("h", "/home/a"), (" ", "/home/a"), (None, None)], "host string, home string")
    told = [r[0] for r in devices.select(identity.device_id(F.col("host"), F.col("home"))).collect()]
    assert told == ["device:" + hashlib.md5(t.encode()).hexdigest() for t in ("h\n/home/a", "(unknown-host)\n/home/a", "(unknown-host)\n(unknown-home)")]
