"""What became of commits: mainline reach, churn, later bugs and reverts, pull requests.

As-of and interval aggregates are sweeps: commits and mainline events of a line are
sorted by time together, and a running maximum or sum tells each commit what comes
after it. So a line that k commits and k events share costs k log k, not k * k. Later bugs are
counted so as well; only commits whose lines different sets of fixes remove are paired with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions import columns as C
from agentlens.operators.attribution import BY_COMMIT, BY_FILE, FILE, MIN_LINES, MIN_RATIO, alias_candidates, alias_names
from agentlens.operators.tables import written

CHURN_DAYS, BUG_DAYS = 14, 60
LINE = ["repo_root", "rel_path", "line_hash"]
COMMIT = ["repo_root", "commit_sha"]
#: As joins and windows sort them, see `attribution`.
BY_LINE = ["line_hash", "rel_path", "repo_root"]


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def most_later(marks: DataFrame, added: DataFrame) -> DataFrame:
    """`marks` (LINE, commit_time, ...) with found: the most that one event at or after commit_time adds of the line (0 if none)."""
    own = [c for c in marks.columns if c not in (*LINE, "commit_time")]
    events = added.filter(F.col("event_time").isNotNull()).groupBy(*LINE, F.col("event_time").alias("_t")).agg(F.max("count").alias("_n"))
    asked = marks.select(*LINE, F.col("commit_time").alias("_t"), F.struct(*own).alias("_own"))
    rows = asked.unionByName(events, allowMissingColumns=True)
    # events come before the commits of their time
    from_end = Window.partitionBy(*BY_LINE).orderBy(F.desc("_t"), F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("_most", F.max("_n").over(from_end)).filter(F.col("_own").isNotNull())
    found = F.coalesce(F.when(F.col("_t").isNotNull(), F.col("_most")), F.lit(0))
    return swept.select(*LINE, F.col("_t").alias("commit_time"), "_own.*", found.alias("found"))


def added_later(budget: DataFrame, added: DataFrame) -> DataFrame:
    """(FILE, commit_time, line_hash, budget, found): the most that one mainline event at or after the commit adds of each line, under its own path."""
    return most_later(budget.select(*LINE, "commit_time", "commit_sha", "budget"), added)


def content_merged(budget: DataFrame, added: DataFrame) -> DataFrame:
    """(COMMIT): commits whose lines reached the mainline, in their files or in renamed ones."""
    own = added_later(budget, added)
    files = written(own.groupBy(*FILE).agg(F.sum("budget").alias("total_lines"), F.sum(F.least("budget", "found")).alias("strict")))
    weak = files.filter(F.col("strict") / F.col("total_lines") < 0.20)
    rows = budget.join(weak.select(*FILE, "total_lines"), BY_FILE)
    known = written(added.select(*LINE).distinct())
    other = alias_candidates(rows.withColumnRenamed("budget", "count"), known, BY_FILE, ["line_hash", "repo_root"])
    tried = rows.join(other, BY_FILE).select("repo_root", F.col("candidate").alias("rel_path"), "line_hash", "commit_time", "commit_sha", F.col("rel_path").alias("_own_path"), "budget", "total_lines")
    there = most_later(tried, added).select("repo_root", "commit_sha", F.col("rel_path").alias("candidate"), F.col("_own_path").alias("rel_path"), "total_lines", F.least("budget", "found").alias("got"))
    scored = written(there.groupBy(*FILE, "total_lines", "candidate").agg(F.sum("got").alias("score")).filter("score > 0"))
    moved = scored.join(alias_names(scored, BY_FILE).withColumnRenamed("alias", "candidate"), [*BY_FILE, "candidate"]).select(*FILE, F.col("score").alias("alias_lines"))
    best = files.join(moved, BY_FILE, "left").withColumn("_best", F.greatest("strict", F.coalesce("alias_lines", F.lit(0))))
    sums = best.groupBy(*COMMIT).agg(F.sum("total_lines").alias("total"), F.sum("_best").alias("got"))
    return sums.filter((F.col("got") >= MIN_LINES) & (F.col("got") / F.col("total") >= MIN_RATIO)).select(*COMMIT)


def revert_times(messages: DataFrame) -> DataFrame:
    """(repo_root, commit_sha, reverted_at): the first time that a message says so."""
    named = messages.select("repo_root", "commit_time", F.explode(C.reverted_shas(F.col("message"))).alias("commit_sha"))
    return named.groupBy("repo_root", "commit_sha").agg(F.min("commit_time").alias("reverted_at"))


def outcomes(commits: DataFrame, budget: DataFrame, added: DataFrame, mainline: DataFrame, reverts: DataFrame) -> DataFrame:
    """`commits` with budget_total, merged_to_mainline_flag, reverted_later_flag and ai_added_lines_reaching_mainline."""
    sums = budget.groupBy(*COMMIT).agg(F.sum("budget").alias("budget_total"))
    joined = (
        commits.join(sums, COMMIT, "left")
        .join(mainline.select(*COMMIT).distinct().withColumn("_on", F.lit(1)), COMMIT, "left")
        .join(content_merged(budget, added).withColumn("_content", F.lit(1)), COMMIT, "left")
        .join(reverts, COMMIT, "left")
        .fillna(0, ["budget_total"])
    )
    merged = (F.col("_on").isNotNull() | F.col("_content").isNotNull()).cast("int")
    late = F.coalesce(F.col("reverted_at") > F.col("commit_time"), F.lit(False)).cast("int")
    flagged = joined.withColumn("merged_to_mainline_flag", merged).withColumn("reverted_later_flag", late)
    return flagged.withColumn("ai_added_lines_reaching_mainline", F.when(merged == 1, F.col("budget_total")).otherwise(0)).drop("_on", "_content", "reverted_at")


def churn(budget: DataFrame, removed: DataFrame, merged: DataFrame) -> DataFrame:
    """(COMMIT, ai_added_lines_removed_within_window): lines of merged commits that the mainline removes in 14 days."""
    events = removed.groupBy(*LINE, F.col("event_time").alias("_t")).agg(F.sum("count").alias("_n")).withColumn("_kind", F.lit(1))
    rows = budget.join(merged.select(*COMMIT), BY_COMMIT, "left_semi")
    # each commit is marked before the events of its own time and after those of the window's end: what is removed between the marks counts
    mark = lambda t, kind: rows.select(*LINE, t.alias("_t"), F.lit(kind).alias("_kind"), F.struct("commit_sha", "budget").alias("_own"))
    marks = mark(F.col("commit_time"), 0).unionByName(mark(F.col("commit_time") + days(CHURN_DAYS), 2))
    until = Window.partitionBy(*BY_LINE).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(events, allowMissingColumns=True).withColumn("_sum", F.coalesce(F.sum("_n").over(until), F.lit(0))).filter("_kind <> 1")
    lines = swept.groupBy(*LINE, F.col("_own.commit_sha").alias("commit_sha"), F.col("_own.budget").alias("budget")).agg(F.sum((F.col("_kind") - 1) * F.col("_sum")).alias("gone")).filter("gone > 0")
    return lines.groupBy(*COMMIT).agg(F.sum(F.least("budget", "gone")).alias("ai_added_lines_removed_within_window"))


def members(*columns: str) -> list[Column]:
    """Two sums of the hashes of a line's distinct rows and their number: what names the set of them."""
    return [F.bit_xor(F.xxhash64(*columns, F.lit(seed))).alias(name) for seed, name in ((1, "_a"), (2, "_b"))] + [F.count("*").alias("_n")]


def one_of_each_class(left: DataFrame, right: DataFrame) -> DataFrame:
    """(LINE): of the lines that both have with the same two sets, one."""
    name = lambda df, c: df.select(*LINE, F.struct("_a", "_b", "_n").alias(c))
    both = name(left, "_left").join(name(right, "_right"), LINE)
    return written(both.groupBy("repo_root", "_left", "_right").agg(F.min(F.struct("rel_path", "line_hash")).alias("_line")).select("repo_root", "_line.*"))


def overlapping_signals(budget: DataFrame, signals: DataFrame) -> DataFrame:
    """(COMMIT, signal_ref, signal_time, source): signals after a commit, within 60 days, that remove lines of it.

    `signals` have LINE, count, anchor_time (which the window is about), signal_time, signal_ref and source. A window
    reaches into two spans of 61 days, which are part of the key: a line only meets signals of about its own time. Lines
    that the same commits add and the same signals remove tell the same pairs, so one of them is asked for all.
    """
    span = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / ((BUG_DAYS + 1) * 86400))
    said = written(signals.filter("count > 0").select(*LINE, "anchor_time", "signal_time", "signal_ref", "source").distinct())
    own = written(budget.filter("budget > 0").select(*LINE, "commit_sha", "commit_time").distinct())
    lines = one_of_each_class(own.groupBy(*LINE).agg(*members("commit_sha", "commit_time")), said.groupBy(*LINE).agg(*members("signal_ref", "anchor_time", "signal_time", "source")))
    told = said.join(lines, LINE, "left_semi").withColumn("_span", span(F.col("anchor_time")))
    asked = own.join(lines, LINE, "left_semi").withColumn("_span", F.explode(F.array(span(F.col("commit_time")), span(F.col("commit_time")) + 1)))
    rows = asked.join(told, [*LINE, "_span"])
    inside = rows.filter((F.col("anchor_time") > F.col("commit_time")) & (F.col("anchor_time") <= F.col("commit_time") + days(BUG_DAYS)))
    return inside.select(*COMMIT, "signal_ref", "signal_time", "source").distinct()


def bugs_after(budget: DataFrame, signals: DataFrame) -> DataFrame:
    """`bug_signals` of `overlapping_signals`, without making the pairs where counting does.

    Lines that the same signals remove are one set. A commit whose lines all have one set is told by a sweep over its
    signals and such commits: of those after a time and after the window's end, the running numbers and the first. Commits
    of several sets are paired, since a signal that is in two of them counts once.
    """
    said = written(signals.filter("count > 0 AND anchor_time IS NOT NULL").select(*LINE, "anchor_time", "signal_time", "signal_ref", "source").distinct())
    sets = said.groupBy(*LINE).agg(*members("anchor_time", "signal_time", "signal_ref", "source"), F.min((F.col("anchor_time") == F.col("signal_time")).cast("int")).alias("_plain"))
    sets = sets.select(*LINE, F.struct("_a", "_b", "_n").alias("_set"), (F.coalesce("_plain", F.lit(0)) == 1).alias("_plain"))
    held = budget.filter("budget > 0").join(sets, BY_LINE).groupBy(*COMMIT, "commit_time", "_set", "_plain").agg(F.min(F.struct("rel_path", "line_hash")).alias("_line"))
    asked = written(held.withColumn("_alone", (F.count("*").over(Window.partitionBy(*COMMIT)) == 1) & F.col("_plain")))
    told = said.join(asked.filter("_alone").groupBy("repo_root", "_set").agg(F.min("_line").alias("_line")).select("repo_root", "_set", "_line.*"), BY_LINE)
    events = told.select("repo_root", "_set", "source", F.col("signal_time").alias("_t"), "signal_ref", F.lit(0).alias("_sign"))
    alone = asked.filter("_alone").join(events.select("repo_root", "_set", "source").distinct(), ["repo_root", "_set"])
    mark = lambda t, sign: alone.select("repo_root", "_set", "source", t.alias("_t"), "commit_sha", F.lit(sign).alias("_sign"))
    marks = mark(F.col("commit_time"), 1).unionByName(mark(F.col("commit_time") + days(BUG_DAYS), -1))
    # from the end; what is of a mark's own time comes after it
    later = Window.partitionBy("repo_root", "_set", "source").orderBy(F.desc("_t"), F.col("_sign") == 0).rowsBetween(Window.unboundedPreceding, 0)
    event = F.col("_sign") == 0
    swept = events.unionByName(marks, allowMissingColumns=True).withColumns({"_later": F.count(F.when(event, 1)).over(later), "_next": F.min(F.when(event, F.struct(F.col("_t").alias("signal_time"), "signal_ref"))).over(later)})
    counted = swept.filter("_sign <> 0").groupBy(*COMMIT, "source").agg(F.sum(F.col("_sign") * F.col("_later")).alias("_n"), F.min(F.when(F.col("_sign") == 1, F.col("_next"))).alias("_first")).filter("_n > 0")
    several = asked.filter("NOT _alone").select(*COMMIT).distinct()
    pairs = overlapping_signals(budget.join(several, BY_COMMIT, "left_semi"), said.withColumn("count", F.lit(1)))
    return summed(counted.unionByName(by_source(pairs)))


def fix_signals(commits: DataFrame, commit_rows: DataFrame) -> DataFrame:
    """What commits remove whose message speaks of a fix and that revert nothing."""
    message = F.col("message")
    fixes = commits.filter(C.is_fix_like(message) & ~C.is_revert(message)).select("repo_root", "commit_sha", "commit_time")
    removed = commit_rows.filter("side = '-'").groupBy(*FILE, "line_hash").agg(F.sum("count").alias("count"))
    return removed.join(fixes, BY_COMMIT).select(*LINE, "count", F.col("commit_time").alias("anchor_time"), F.col("commit_time").alias("signal_time"), F.col("commit_sha").alias("signal_ref"), F.lit("git_fix_commit").alias("source"))


def issue_signals(issues: DataFrame, links: DataFrame, pulls: DataFrame, removed: DataFrame) -> DataFrame:
    """What merged pull requests remove that fix a bug issue."""
    bugs = issues.filter((F.col("bug_candidate_flag") == 1) & (F.col("is_pull_request_flag") == 0)).select("repo_key", "issue_number")
    merged = pulls.filter(F.col("merged_at").isNotNull() & (F.col("removed_hashes_complete_flag") == 1)).select("repo_key", "repo_root", "pr_number", "merged_at")
    joined = bugs.join(links, ["repo_key", "issue_number"]).join(merged, ["repo_key", "pr_number"]).join(removed, ["repo_key", "pr_number"])
    ref = F.concat(F.lit("issue#"), F.col("issue_number").cast("string"), F.lit("/pr#"), F.col("pr_number").cast("string"))
    return joined.select(*LINE, "count", F.col("merged_at").alias("anchor_time"), F.col("merged_at").alias("signal_time"), ref.alias("signal_ref"), F.lit("github_issue_fix_pr_exact_hash").alias("source"))


def by_source(found: DataFrame) -> DataFrame:
    """(COMMIT, source, _n, _first) of `overlapping_signals`."""
    return found.groupBy(*COMMIT, "source").agg(F.count("*").alias("_n"), F.min(F.struct("signal_time", "signal_ref")).alias("_first"))


def summed(counts: DataFrame) -> DataFrame:
    """(COMMIT, bug_after_merge_flag, first signal, count, source) of `by_source`."""
    return counts.groupBy(*COMMIT).agg(
        F.lit(1).alias("bug_after_merge_flag"),
        F.min("_first").alias("_first"),
        F.sum("_n").alias("bug_signal_count"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("signal_source"),
    ).select(*COMMIT, "bug_after_merge_flag", F.col("_first.signal_ref").alias("first_bug_signal_commit_sha"), F.col("_first.signal_time").alias("first_bug_signal_commit_time"), "bug_signal_count", F.lit(BUG_DAYS).alias("window_days"), "signal_source")


def bug_signals(found: DataFrame) -> DataFrame:
    """(COMMIT, bug_after_merge_flag, first signal, count, source) of commits with signals."""
    return summed(by_source(found))


def owning_pull(pulls_of_commit: DataFrame) -> DataFrame:
    """(repo_key, commit_sha, owning_pr_number): the pull request created first, unknown times last."""
    order = F.struct(F.col("created_at").isNull().alias("unknown"), "created_at", "pr_number")
    return pulls_of_commit.groupBy("repo_key", "commit_sha").agg(F.min(order).alias("o")).select("repo_key", "commit_sha", F.col("o.pr_number").alias("owning_pr_number"))


def first_links(timeline: DataFrame) -> DataFrame:
    """(repo_key, issue_number, pr_number, linked_at): the first time, where one is known."""
    return timeline.groupBy("repo_key", "issue_number", "pr_number").agg(F.min_by("linked_at", F.when(F.col("linked_at").isNotNull(), F.col("position"))).alias("linked_at"))


def pr_outcomes(outcome: DataFrame, lookups: DataFrame, pulls: DataFrame) -> DataFrame:
    """Heavy commits on the hosted repositories with an answered lookup, and what became of their pull request."""
    heavy = outcome.filter((F.col("heavy_ai_flag") == 1) & F.col("repo_key").startswith("git:github.com/")).select(*COMMIT, "repo_key", "commit_time")
    known = lookups.filter(F.col("status").isin("resolved", "no_pr")).select("repo_key", "commit_sha", F.col("status").alias("lookup_status"), F.col("owning_pr_number").alias("pr_number"))
    own = pulls.select("repo_key", "pr_number", "merged")
    joined = heavy.join(known, ["repo_key", "commit_sha"]).join(own, ["repo_key", "pr_number"], "left")
    opened = (F.col("lookup_status") == "resolved").cast("int")
    return joined.select(*COMMIT, "lookup_status", "pr_number", opened.alias("pr_opened_flag"), F.when(opened == 1, F.coalesce("merged", F.lit(0))).otherwise(0).cast("int").alias("pr_merged_flag"))
