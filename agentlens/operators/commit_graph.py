"""Branches' commits from the commit graph, by paths of first parents that no two share.

Relations: `parents` (repo_root, commit_sha, parent_sha, parent_index; a root has no row) and `tips` (repo_root, branch,
commit_sha). Each commit goes on to the one of its first-parent children that has most commits above it, so the forest of
first parents falls into paths, and a first-parent chain runs through few of them: the number at most doubles as the
graph squares. What a branch holds of a path is its beginning, so a branch is told by how far it reaches on each path; the
commits are listed last, once each. Sums and paths are found by pointer doubling over numbers, whose steps grow with the
logarithm of the longest chain; ancestors also take a step for each level that merges nest.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.operators.tables import discarded, written

COMMIT = ["repo_root", "commit_sha"]
MARK = ["repo_root", "branch", "commit_sha"]
BY_COMMIT = ["commit_sha", "repo_root"]
#: Commits of a path that are listed together, and commits of a repository that are numbered together.
BLOCK = 1024


class Graph:
    """Paths of the commits of `parents` and `tips`. Commits go by numbers (_id); tables are made when they are first asked for."""

    def __init__(self, tips: DataFrame, parents: DataFrame):
        self._tips, self._parents = tips.select(*MARK), parents

    @cached_property
    def commits(self) -> DataFrame:
        """(COMMIT, _id) of every commit that is a tip, has a parent or is one."""
        named = self._parents.select(*COMMIT).unionByName(self._parents.select("repo_root", F.col("parent_sha").alias("commit_sha"))).unionByName(self._tips.select(*COMMIT))
        return written(named.filter("repo_root IS NOT NULL AND commit_sha IS NOT NULL").distinct().withColumn("_id", F.monotonically_increasing_id()))

    @cached_property
    def edges(self) -> DataFrame:
        """(_id, _to, parent_index)."""
        to = self.commits.select("repo_root", F.col("commit_sha").alias("parent_sha"), F.col("_id").alias("_to"))
        return written(self._parents.join(self.commits, BY_COMMIT).join(to, ["parent_sha", "repo_root"]).select("_id", "_to", "parent_index").distinct())

    @cached_property
    def tips(self) -> DataFrame:
        """(repo_root, branch, _id)."""
        return self._tips.join(self.commits, BY_COMMIT).select("repo_root", "branch", "_id")

    @cached_property
    def _sized(self) -> DataFrame:
        """(_id, _to, _depth, _n): the first parent, the steps to the root and the number of commits above, itself among them."""
        first = self.edges.filter("parent_index = 0").select("_id", "_to")
        table = self.commits.select("_id").join(first, "_id", "left").select("_id", "_to", F.col("_to").isNotNull().cast("bigint").alias("_depth"), F.lit(1).cast("bigint").alias("_n"))
        table = written(table)
        while not table.filter("_to IS NOT NULL").isEmpty():
            # what is known of the next 2^k steps, and of the last ones, gives it for 2^(k+1)
            on = table.select(F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_depth").alias("_more"))
            under = table.filter("_to IS NOT NULL").groupBy(F.col("_to").alias("_id")).agg(F.sum("_n").alias("_above"))
            moved = table.filter("_to IS NOT NULL").join(on, "_to").select("_id", F.col("_next").alias("_to"), (F.col("_depth") + F.col("_more")).alias("_depth"), "_n").unionByName(table.filter("_to IS NULL"))
            after = written(moved.join(under, "_id", "left").select("_id", "_to", "_depth", (F.col("_n") + F.coalesce("_above", F.lit(0).cast("bigint"))).alias("_n")))
            discarded(table)
            table = after
        return written(table.drop("_to").join(first, "_id", "left").select("_id", "_to", "_depth", "_n"))

    @cached_property
    def places(self) -> DataFrame:
        """(_id, _path, _at, _to): each commit's path, by its first commit, its place (the steps to the root) and its first parent."""
        onward = self._sized.filter("_to IS NOT NULL").groupBy(F.col("_to")).agg(F.max_by("_id", F.struct("_n", "_id")).alias("_id"))
        table = written(self._sized.select("_id").join(onward, "_id", "left").select("_id", F.coalesce("_to", "_id").alias("_path"), F.col("_to").isNull().alias("_done")))
        while not table.filter("NOT _done").isEmpty():
            on = table.select(F.col("_id").alias("_path"), F.col("_path").alias("_next"), F.col("_done").alias("_ends"))
            after = written(table.filter("NOT _done").join(on, "_path").select("_id", F.col("_next").alias("_path"), F.col("_ends").alias("_done")).unionByName(table.filter("_done")))
            discarded(table)
            table = after
        return written(table.select("_id", "_path").join(self._sized.select("_id", F.col("_depth").alias("_at"), "_to"), "_id"))

    @cached_property
    def _below(self) -> DataFrame:
        """(_path, _on, _to_at): the path that a path's first commit has its first parent on, and where."""
        firsts = self.places.filter("_id = _path AND _to IS NOT NULL").select("_path", "_to")
        return written(firsts.join(self.places.select(F.col("_id").alias("_to"), F.col("_path").alias("_on"), F.col("_at").alias("_to_at")), "_to").select("_path", "_on", "_to_at"))

    @cached_property
    def chains(self) -> DataFrame:
        """(repo_root, branch, _path, _until, _depth): the paths of each tip's first-parent chain, how far up, and the tip's steps to the root."""
        fresh = written(self.tips.join(self.places, "_id").select("repo_root", "branch", "_path", F.col("_at").alias("_until"), F.col("_at").alias("_depth")))
        parts = [fresh]
        while not fresh.isEmpty():
            fresh = written(fresh.join(self._below, "_path").select("repo_root", "branch", F.col("_on").alias("_path"), F.col("_to_at").alias("_until"), "_depth"))
            parts.append(fresh)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return written(whole)

    @cached_property
    def reached(self) -> DataFrame:
        """(repo_root, branch, _path, _until): how far up on each path a tip's ancestors are, by any parent."""
        place = self.places.select("_id", "_path", "_at")
        to = place.select(F.col("_id").alias("_to"), F.col("_path").alias("_on"), F.col("_at").alias("_to_at"))
        merges = self.edges.filter("parent_index > 0").join(place, "_id").join(to, "_to").select("_path", "_at", "_on", "_to_at")
        # from a path's beginning to its parent's path
        firsts = self._below.join(place.filter("_id = _path").select("_path", "_at"), "_path").select("_path", "_at", "_on", "_to_at")
        ways = written(merges.unionByName(firsts).filter("_path <> _on").groupBy("_path", "_on", "_at").agg(F.max("_to_at").alias("_most")))
        others = written(ways.select("_path", "_on").distinct())
        mark = ["repo_root", "branch", "_path"]
        known = written(self.tips.join(place, "_id").groupBy(*mark).agg(F.max("_at").alias("_until")))
        fresh = known
        # ways up to a mark come before it
        up = Window.partitionBy("_path", "_on").orderBy("_at", F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        while not fresh.isEmpty():
            asked = fresh.join(others, "_path").select("_path", "_on", F.col("_until").alias("_at"), F.struct("repo_root", "branch").alias("_mark"))
            met = asked.unionByName(ways, allowMissingColumns=True).withColumn("_further", F.max("_most").over(up)).filter("_mark IS NOT NULL AND _further IS NOT NULL")
            found = met.groupBy("_mark.repo_root", "_mark.branch", F.col("_on").alias("_path")).agg(F.max("_further").alias("_further"))
            fresh = written(found.join(known, mark, "left").filter("_until IS NULL OR _further > _until").select(*mark, F.col("_further").alias("_until")))
            known = written(known.unionByName(fresh).groupBy(*mark).agg(F.max("_until").alias("_until")))
        return known

    def listed(self, marks: DataFrame) -> DataFrame:
        """`marks` (_path, _until, ...) with the commits (commit_sha, _at) of each path up to there. Commits meet them in blocks, so a long path is no single task."""
        block = lambda at: F.floor(F.col(at) / BLOCK)
        rows = self.places.join(self.commits, "_id").select("_path", block("_at").alias("_block"), "_at", "commit_sha")
        begins = self.places.filter("_id = _path").select("_path", F.col("_at").alias("_begin"))
        asked = marks.join(begins, "_path").withColumn("_block", F.explode(F.sequence(block("_begin"), block("_until")))).drop("_begin")
        return asked.join(rows, ["_path", "_block"]).filter(F.col("_at") <= F.col("_until")).drop("_block")


def first_parent_chains(tips: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo_root, branch, commit_sha, distance): each tip's commits, first parent by first parent, with the steps from the tip."""
    graph = Graph(tips, parents)
    return graph.listed(graph.chains).select(*MARK, (F.col("_depth") - F.col("_at")).alias("distance"))


def ancestors(tips: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo_root, branch, commit_sha): all commits that a tip reaches, by any parent."""
    graph = Graph(tips, parents)
    return graph.listed(graph.reached).select(*MARK)


def owners(tips: DataFrame, parents: DataFrame, integration: list[str]) -> DataFrame:
    """(COMMIT, n_owners, nearest): by how many branches' first-parent chains a commit is held, and the fewest steps from a
    tip, of commits that no integration branch has on its own. Chains aren't listed: tips are counted from the ends of paths down.
    """
    graph = Graph(tips, parents)
    ends = written(graph.chains.groupBy("_path", "_until").agg(
        F.count(F.when(~F.col("branch").isin(*integration), 1)).alias("_own"), F.max(F.col("branch").isin(*integration).cast("int")).alias("_shared"), F.min(F.when(~F.col("branch").isin(*integration), F.col("_depth"))).alias("_nearest"),
    ))
    # from a path's last commit down: what ends at a commit or above it holds it
    down = Window.partitionBy("_path").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = graph.places.select("_id", "_path", "_at").join(ends.withColumnRenamed("_until", "_at"), ["_path", "_at"], "left")
    told = rows.select("_id", "_at", F.sum("_own").over(down).alias("n_owners"), F.max("_shared").over(down).alias("_shared"), F.min("_nearest").over(down).alias("_nearest"))
    return told.filter("n_owners > 0 AND coalesce(_shared, 0) = 0").join(graph.commits, "_id").select(*COMMIT, "n_owners", (F.col("_nearest") - F.col("_at")).alias("nearest"))


def positions(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """`rows` with their place, from 0, among those of their keys in `order`. Ranges of rows are sorted each, so a key with many rows is no single task."""
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))  # a row for each key in each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return ranged.withColumn("_within", within).join(before, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_range", "_within", "_before")


def branch_commits(tips: DataFrame, parents: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_root, branch, commit_sha, distance, on_first_parent) of every commit that a branch holds: what `branches` reads.

    The distance counts from the tip in the order of time, latest first; `commits` are (repo_root, commit_sha, commit_time).
    A repository's commits are put in that order once and cut into blocks. A branch keeps what it holds of each block, in
    order, and counts of the blocks before tell the distance, so the listed rows are neither sorted nor moved.
    """
    graph = Graph(tips, parents)
    timed = commits.select(*COMMIT, "commit_time").join(graph.commits, BY_COMMIT).join(graph.places.select("_id", "_path", "_at"), "_id")
    placed = positions(timed, ["repo_root"], [F.desc("commit_time"), F.col("commit_sha")], "_rank").withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    placed = written(placed.select("repo_root", "_block", "_rank", "commit_sha", "_path", "_at"))
    block = ["repo_root", "_block"]
    blocks = written(placed.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("_rank", "commit_sha", "_path", "_at"))).alias("_commits")), **{"parquet.block.size": str(1 << 20)})
    paths = placed.groupBy(*block, "_path").agg(F.min("_at").alias("_least"))
    spine = graph.chains.groupBy("repo_root", "branch", "_path").agg(F.max("_until").alias("_spine"))
    reach = graph.reached.join(spine, ["repo_root", "branch", "_path"], "left")
    limit = F.struct("_until", F.coalesce("_spine", F.lit(-1).cast("bigint")).alias("_spine"))
    # of each block, the paths that a branch reaches there
    limits = reach.join(paths, ["_path", "repo_root"]).filter(F.col("_least") <= F.col("_until")).groupBy(*block, "branch").agg(F.map_from_entries(F.collect_list(F.struct("_path", limit))).alias("_limits"))
    limits = written(limits)
    kept = F.filter("_commits", lambda c: F.coalesce(c["_at"] <= F.col("_limits")[c["_path"]]["_until"], F.lit(False)))
    held = lambda asked: blocks.join(asked, block).withColumn("_held", kept).drop("_commits")
    counts = written(held(limits).select(*block, "branch", F.size("_held").alias("_n")))
    earlier = Window.partitionBy("repo_root", "branch").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*block, "branch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = held(limits.join(before, [*block, "branch"])).select("repo_root", "branch", "_limits", "_before", F.posexplode("_held").alias("_place", "_commit"))
    on_spine = F.col("_commit._at") <= F.col("_limits")[F.col("_commit._path")]["_spine"]
    return rows.select("repo_root", "branch", F.col("_commit.commit_sha").alias("commit_sha"), (F.col("_before") + F.col("_place")).alias("distance"), on_spine.cast("int").alias("on_first_parent"))
