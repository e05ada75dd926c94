"""The ladder for partial diffs without a path, on small cases and against all candidates."""

import random
from collections import Counter

from pyspark.sql import functions as F

from agentlens.sources import path_resolution, store_changes

LINES, HINTS, PATHS = "session_id string, item string, side string, line string", "session_id string, hint_id int, path string, original_lines array<string>", "session_id string, path string, kind string"


def run(spark, lines, hints=(), paths=(), originals=(), seen=(), files=()):
    frame = lambda rows, kinds: spark.createDataFrame(list(rows), kinds)
    found, errors = path_resolution.resolved(frame(lines, LINES), frame(hints, HINTS), frame(paths, PATHS), frame(originals, "session_id string, path string, content string"), frame(seen, "session_id string, path string"), frame(files, "repo_root string, path string, content string"))
    return {r["item"]: (r["path"], r["rung"]) for r in found.collect()}, {r["item"]: r["error"] for r in errors.collect()}


def test_each_rung(spark):
    line = lambda s, side="+", text="some text": (s, s, side, text)
    lines = [line("one"), line("ahead", "-", "old"), line("firm"), line("same"), line("weak"), line("content", text="rare = 1"), line("tie", text="both"), line("none"), line("seen"), line("plan")]
    hints = [("one", 1, "/r/a", ["x"]), ("ahead", 2, "/r/a", ["x"]), ("ahead", 3, "/r/b", ["old"]), ("same", 4, "/r/a", ["x"]), ("same", 5, "/r/a", ["x"]), ("content", 6, "/r/src/a.py", ["x"]), ("content", 7, "/r/src/b.py", ["x"]), ("tie", 8, "/r/src/a.py", ["x"]), ("tie", 9, "/r/src/b.py", ["x"]), ("seen", 10, "/r/a", ["x"]), ("seen", 11, "/r/b", ["x"])]
    paths = [("firm", "/r/a", "checkpoint"), ("firm", "/r/a", "strong"), ("firm", "/r/b", "weak"), ("weak", "/r/b", "weak"), ("plan", "/r/.cursor/plans/a.md", "weak"), ("plan", "/r/.cursor/plans/b.md", "weak")]
    files = [("/r", "/r/src/a.py", "both\nx = 1\n"), ("/r", "/r/src/b.py", "both\nrare = 1\n"), ("/r", "/r/dist/c.py", "rare = 1\nrare = 1\n"), ("/r", "/r/lib/d.py", "other\n")]
    found, errors = run(spark, lines, hints, paths, seen=[("seen", "/r/a")], files=files)
    assert found == {"one": ("/r/a", 0), "ahead": ("/r/b", 1), "firm": ("/r/a", 2), "same": ("/r/a", 3), "weak": ("/r/b", 4), "content": ("/r/src/b.py", 5), "seen": ("/r/b", 0)}
    assert errors == {"tie": "ambiguous partial diff: 2 paths are named"}


def test_contentful_lines(spark):
    told = {t: t in ("abc", " é1 ", "a b") for t in ("abc", "ab", "  ab ", "{};", "---", " é1 ", "a b", "")}
    assert {r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in told], "t string").select("t", path_resolution.contentful(F.col("t")).alias("c")).collect()} == told


def test_rare_lines_first_lose_nothing(spark):
    """Items over files that share hot lines: the confident paths are those of trying every file."""
    rng = random.Random(7)
    line = lambda: f"line {int(40 * rng.random() ** 3)}"
    files = [("/r", f"/r/d{i % 4}/f{i}.py", "\n".join(line() for _ in range(rng.randint(1, 12)))) for i in range(80)]
    lines = [(f"s{i}", f"i{i}", rng.choice("++-"), line()) for i in range(60) for _ in range(rng.randint(1, 9))]
    hints = [(f"s{i}", 2 * i + k, f"/r/d{rng.randint(0, 3)}/f{rng.randint(0, 90)}.py", [line() for _ in range(3)]) for i in range(60) for k in range(2)]
    originals = [(f"s{i}", f"/r/d{rng.randint(0, 3)}/f{rng.randint(0, 79)}.py", line() + "\n" + line()) for i in range(0, 60, 3)]
    named = sorted({(s, s.replace("s", "i"), "/r", p) for s, _, p, _ in hints})
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    ranks = path_resolution.content_ranks(frame(lines, LINES), frame(named, "session_id string, item string, repo_root string, path string"), frame(hints, HINTS), frame([("s1", "/r/d0/f4.py", "weak")], PATHS), frame(originals, "session_id string, path string, content string"), path_resolution.content_index(frame(files, "repo_root string, path string, content string")))
    got = {r["item"]: r["path"] for r in store_changes.confident_paths(ranks).collect()}

    index = {p: Counter(t.split("\n")) for _, p, t in files}
    size = lambda a, b: sum((a & b).values())
    told = []
    for i in range(60):
        s, item = f"s{i}", f"i{i}"
        added, removed = (Counter(x[3] for x in lines if x[1] == item and x[2] == side) for side in "+-")
        own = {p for _, it, _, p in named if it == item}
        steps = lambda p: p.split("/")[2:]
        for p in own | {p for p, c in index.items() if size(added, c)}:
            old = [Counter(h[3]) for h in hints if h[0] == s and h[2] == p] + [Counter(t.split("\n")) for a, b, t in originals if (a, b) == (s, p)]
            others = [steps(q) for q in own if q != p]
            near = max((next((k for k, (a, b) in enumerate(zip(steps(p), q)) if a != b), min(len(steps(p)), len(q))) for q in others), default=0)
            told.append((s, item, p, max((size(removed, c) for c in old), default=0), size(added, index.get(p, Counter())), size(removed, index.get(p, Counter())), 0, 0, int((s, p) == ("s1", "/r/d0/f4.py")), int(any(steps(p)[-1] == q[-1] for q in others)), near))
    every = frame(told, "session_id string, item string, path string, " + ", ".join(f"{c} int" for c in store_changes.RANK))
    assert got == {r["item"]: r["path"] for r in store_changes.confident_paths(every).collect()} and len(got) > 20
    mine = {(r["item"], r["path"]): tuple(r[c] for c in store_changes.RANK) for r in ranks.collect()}
    plain = {(x[1], x[2]): x[3:] for x in told}
    assert all(plain[k] == v for k, v in mine.items()) and len(mine) < len(plain)
