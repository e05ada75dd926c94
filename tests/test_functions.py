import random
import time
from collections import Counter

from pyspark.sql import functions as F

from agentlens.functions import columns as C
from agentlens.functions import hashing as H


def values(spark, inputs, build, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_task_keys(spark):
    names = ["PAC-12_x", "feature/pac-7", "main", "codex/PAC-999-demo", "xPAC12", "fix_9", "a1b-2"]
    assert values(spark, names, C.task_key) == ["PAC-12", "PAC-7", "main", "PAC-999", "xPAC12", "FIX-9", "a1b-2"]


def test_status_bands(spark):
    assert values(spark, [3.9, 4.0, 7.0, 7.1, None], lambda c: C.status_band(c, 4, 7, False), "double") == ["good", "watch", "watch", "risk", "n/a"]
    assert values(spark, [75.0, 50.0, 49.9], lambda c: C.status_band(c, 75, 50, True), "double") == ["good", "watch", "risk"]


def test_models(spark):
    assert values(spark, [None, "  ", "Claude/x", "x"], lambda c: C.normalized_model(F.lit("claude"), c)) == ["claude/(unknown)", "claude/(unknown)", "Claude/x", "claude/x"]


def test_signals(spark):
    assert values(spark, ["2 errors found", "errors 2", "Build failed", "lint has failed", "it failed", "Traceback"], C.is_error_paste) == [True, False, True, True, False, True]
    assert values(spark, ["TypeError: x at /a/b line 12, see https://h/x deadbeef01", "fine", "hello\n  Error: no 7 \nz"], C.error_signature) == ["typeerror: x at <path> line # see <url> <sha>", None, "error: no #"]
    assert values(spark, ["same error", "Still Broken!", "ok"], C.is_continuation) == [True, True, False]


def test_messages(spark):
    sha = "0123456789ABCDEF0123456789abcdef01234567"
    assert values(spark, [f"Revert x\n\nThis reverts commit {sha}.", "This reverts commit abc."], C.reverted_shas) == [[sha.lower()], []]
    assert values(spark, ["Fixes y", "prefix", " Revert z"], C.is_fix_like) == [True, False, False]
    assert values(spark, ["Fixes y", "prefix", " Revert z"], C.is_revert) == [False, False, True]


def test_repo_keys(spark):
    urls = ["git@GitHub.com:acme/x.git", "https://user:t@github.com/acme/x/", "ssh://git@host/a/b.git", "nothing", "git@host"]
    assert values(spark, urls, C.repo_key) == ["git:github.com/acme/x", "git:github.com/acme/x", "git:host/a/b", None, None]


def test_weeks_and_words(spark):
    assert [str(x) for x in values(spark, ["2024-01-07 23:00:00", "2024-01-08 00:00:00"], lambda c: C.week_start(c.cast("timestamp")))] == ["2024-01-01", "2024-01-08"]
    assert values(spark, [" a  b\n", "", None], C.word_count) == [2, 0, 0]


def test_lines_and_hashes(spark):
    assert values(spark, ["a\nb\n", "", "a\n\nb"], H.lines_of) == [["a", "b"], [], ["a", "", "b"]]
    assert len(set(values(spark, ["a", "a \t\r", " a"], H.line_hash))) == 2
    rows = spark.createDataFrame([(1, "a\nb\nc\n", "a\nc\nd\n"), (2, "", ""), (3, None, "x")], "i int, b string, a string")
    got = {r["i"]: (r["added"], r["removed"]) for r in H.with_line_diff(rows, "b", "a").collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (1, 0)}


def plain_common(a, b):
    """Length of a longest common part, by the table of all beginnings."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_line_diffs_are_the_shortest(monkeypatch):
    rng = random.Random(2)
    for kept in (1 << 24, 60):  # with few kept cells the tables are halved
        monkeypatch.setattr(H, "KEPT_CELLS", kept)
        for _ in range(300):
            old, new = ([rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
            if rng.random() < 0.5:
                new = [x for x in old if rng.random() < 0.8]
            added, removed, out = H.diff_counts("\n".join(old) + "\n" * bool(old), "\n".join(new) + "\n" * bool(new))
            n = plain_common(old, new)
            assert (added, removed) == (len(new) - n, len(old) - n)
            # what is left of one side without its changes is what is left of the other
            gone, come = ([x for s, x in out if s == side] for side in "-+")
            assert Counter(old) - Counter(gone) == Counter(new) - Counter(come) and len(gone) == removed and len(come) == added


def test_long_line_diffs_are_quick():
    rng = random.Random(3)
    old, new = ([f"line {rng.randint(0, 30_000)}" if i % 5 else "common" for i in range(50_000)] for _ in range(2))
    began = time.time()
    added, removed, _ = H.diff_counts("\n".join(old), "\n".join(new))
    assert added == removed > 10_000 and time.time() - began < 10
    assert H.diff_counts("\n".join(old), "\n".join(old[:25_000] + ["new"] + old[25_000:]))[:2] == (1, 0)
