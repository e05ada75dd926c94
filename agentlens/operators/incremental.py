"""Incremental work: cursors over files, upserts, replacement, dirty hashes, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.hashing import differs
from agentlens.operators import attribution
from agentlens.operators.tables import written


def changed_files(files: DataFrame, cursors: DataFrame, parser: str) -> DataFrame:
    """Files (path, mtime, size) that this parser's version hasn't read as they are now."""
    seen = cursors.filter(F.col("provider") == parser).select(F.col("source_file").alias("path"), F.col("file_mtime").alias("mtime"), F.col("file_size").alias("size"))
    return files.join(seen, ["path", "mtime", "size"], "left_anti")


def advanced_cursors(cursors: DataFrame, files: DataFrame, parser: str) -> DataFrame:
    new = files.select(F.lit(parser).alias("provider"), F.col("path").alias("source_file"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))
    return replaced(cursors, new, ["provider", "source_file"])


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the keys of `new`, and `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """One row for each key; columns by `policy`: new (if not null, else old), least, greatest."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))

    def merged(name: str) -> Column:
        kind = policy[name]
        if kind == "least":
            return F.min(name).alias(name)
        if kind == "greatest":
            return F.max(name).alias(name)
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_new"))).alias(name)

    return rows.groupBy(*keys).agg(*[merged(c) for c in old.columns if c not in keys])


def session_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later logs add to what is known of a session and widen its time."""
    policy = {c: "new" for c in old.columns} | {"started_at": "least", "ended_at": "greatest"}
    return upserted(old, new, ["provider", "session_id"], policy)


def new_sessions(found: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions whose id no provider has brought before."""
    return found.join(known.select("session_id").distinct(), "session_id", "left_anti")


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def reconciled(old: DataFrame, new: DataFrame, keys: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """The operations of a source after another read of it, and those that are gone: what changed or is new takes `version`, the rest keeps its own.

    `old` have keys, (repo_root, side, line_hash, count) and version; `new` the same without version.
    """
    on = ["repo_root", "side", "line_hash"]
    changed = differs(old.drop("version"), new, keys, on).withColumn("_changed", F.lit(1))
    before = old.select(*keys, "version").distinct()
    now = new.join(changed, keys, "left").join(before, keys, "left")
    kept = now.withColumn("version", F.when(F.col("_changed").isNull(), F.col("version")).otherwise(F.lit(version))).drop("_changed")
    return kept, before.join(new.select(*keys).distinct(), keys, "left_anti")


def repositories(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count_distinct("repo_root").alias("n_repositories"))


def issue_scan_starts(commits: DataFrame) -> DataFrame:
    """From when on a repository's issues matter: its first commit."""
    return commits.groupBy("repo_root").agg(F.min("commit_time").alias("scan_from"))


def dirty_hashes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(repo_root, side, line_hash) of operations that came, went or changed between two reads of a source."""
    on = ["repo_root", "side", "line_hash"]
    changed = differs(old, new, keys, on)
    return old.unionByName(new).join(changed, keys, "left_semi").select(*on).distinct()


def dirty_commits(commit_rows: DataFrame, dirty: DataFrame) -> DataFrame:
    """Commits that hold a dirty line."""
    return commit_rows.join(dirty, ["line_hash", "repo_root", "side"], "left_semi").select("repo_root", "commit_sha").distinct()


def planned_commits(listed: DataFrame, cached: DataFrame, dirty: DataFrame, changed_branches: DataFrame) -> DataFrame:
    """(repo_root, commit_sha, recompute, task_only): new commits, dirty ones, and all of a repository whose branches moved."""
    keys = ["repo_root", "commit_sha"]
    fresh = listed.join(cached, keys, "left_anti").select(*keys, F.lit(2).alias("_why"))
    stale = cached.join(dirty, keys, "left_semi").select(*keys, F.lit(2).alias("_why"))
    moved = cached.join(changed_branches, "repo_root", "left_semi").select(*keys, F.lit(1).alias("_why"))
    best = fresh.unionByName(stale).unionByName(moved).groupBy(*keys).agg(F.max("_why").alias("_why"))
    return best.select(*keys, (F.col("_why") == 2).cast("int").alias("recompute"), (F.col("_why") == 1).cast("int").alias("task_only"))


def scan_starts(session_rows: DataFrame) -> DataFrame:
    """A day before the first change that a session made in a repository."""
    return session_rows.filter(F.col("repo_root").isNotNull()).groupBy("repo_root").agg((F.min("change_ts") - F.expr("INTERVAL 1 DAY")).alias("scan_from"))


def lookups_to_retry(commits: DataFrame, lookups: DataFrame) -> DataFrame:
    """Commits without a resolved lookup."""
    return commits.join(lookups.filter("status = 'resolved'").select("repo_key", "commit_sha"), ["repo_key", "commit_sha"], "left_anti")


def pulls_to_refresh(pulls: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """Open pull requests last read longer ago than the time to live."""
    return pulls.filter((F.col("state") == "open") & (F.col("last_checked_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))


def running_index(changes: DataFrame, known: DataFrame) -> DataFrame:
    """change_index that goes on after what each session has."""
    keys = ["provider", "session_id"]
    last = known.groupBy(*keys).agg(F.max("change_index").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("change_ts", "change_id")
    return changes.join(last, keys, "left").withColumn("change_index", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.row_number().over(order) - 1).drop("_last")


COMMIT = ["repo_root", "commit_sha"]


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_root, side, line_hash) of which a session has more, less or for the first time, under some path, than it had at the read before."""
    who = [*attribution.BY_LINE, "provider", "session_id"]
    read = lambda rows, at: rows.filter("rel_path IS NOT NULL").select(*who, "count", F.lit(at).alias("_at"))
    both = read(old, 0).unionByName(read(new, 1))
    most = lambda at: F.max(F.when(F.col("_at") == at, F.col("count")))
    changed = both.groupBy(*who).agg(most(0).alias("_old"), most(1).alias("_new")).filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return changed.select("repo_root", "side", "line_hash").distinct()


def stale_commits(known: DataFrame, commit_rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(COMMIT) to attribute again: those of `commit_rows` that hold a line of which sessions have something else now, or that aren't among the `known`."""
    fresh = commit_rows.select(*COMMIT).distinct().join(known.select(*COMMIT), COMMIT, "left_anti")
    return written(dirty_commits(commit_rows, changed_lines(old, new)).unionByName(fresh).distinct())


#: Commits to attribute again up to this number (under 100 bytes each) are broadcast; more join by shuffle.
MOST_COMMITS = 200_000


class Reassociation:
    """What `attribution.attributed` gives for all of `commit_rows` and the sessions' `new` rows, from its results for the `old` ones.

    What a commit gets depends on what sessions have of its own lines, under any path. So only commits that hold a changed
    line, or that weren't there before (`known` were), are attributed, and only session rows of their lines are read for it.
    """

    def __init__(self, known: DataFrame, commit_rows: DataFrame, old: DataFrame, new: DataFrame):
        self.again = stale_commits(known, commit_rows, old, new)
        few = self.again.limit(MOST_COMMITS + 1).count() <= MOST_COMMITS
        self._gone = F.broadcast(self.again) if few else self.again
        rows = commit_rows.join(self._gone, attribution.BY_COMMIT, "left_semi")
        lines = rows.select("repo_root", "side", "line_hash").distinct()
        self._matched = attribution.Matched(rows, new.join(lines, ["line_hash", "repo_root", "side"], "left_semi"))
        self._own = written(attribution.commit_facts(self._matched))

    def _kept(self, before: DataFrame, now: DataFrame) -> DataFrame:
        return before.join(self._gone, COMMIT, "left_anti").unionByName(now)

    def facts(self, before: DataFrame) -> DataFrame:
        return self._kept(before, self._own)

    def shares(self, before: DataFrame, of_commits: DataFrame | None = None) -> DataFrame:
        """`of_commits` has more columns of all commits, as `before` has them already."""
        return self._kept(before, attribution.session_shares(self._matched, self._own, of_commits))


def reassociated(facts: DataFrame, shares: DataFrame, commit_rows: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`Reassociation` of results for the `old` rows: facts, shares, and which commits were attributed again."""
    now = Reassociation(facts, commit_rows, old, new)
    return now.facts(facts), now.shares(shares), now.again
