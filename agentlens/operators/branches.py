"""Which branch, and so which task, a commit belongs to.

Input: (repo_root, branch, commit_sha, distance, on_first_parent), a row for each
branch that holds a commit; distance counts from the branch's tip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions import columns as C

COMMIT = ["repo_root", "commit_sha"]


def owned(branch_commits: DataFrame) -> DataFrame:
    """First-parent commits of a branch that no integration branch has on its own first-parent line."""
    spine = branch_commits.filter("on_first_parent = 1")
    shared = spine.filter(F.col("branch").isin(*C.INTEGRATION_BRANCHES)).select(*COMMIT)
    return spine.filter(~F.col("branch").isin(*C.INTEGRATION_BRANCHES)).join(shared, COMMIT, "left_anti")


def primary(branch_commits: DataFrame) -> DataFrame:
    """The owning branch with its tip nearest; the confidence is how far the next one is."""
    order = Window.partitionBy(*COMMIT).orderBy("distance", "branch")
    ranked = owned(branch_commits).withColumn("_rank", F.row_number().over(order)).withColumn("_margin", F.lead("distance").over(order) - F.col("distance"))
    counted = ranked.withColumn("candidate_count", F.count("*").over(Window.partitionBy(*COMMIT))).filter("_rank = 1")
    confidence = F.when(F.col("_margin").isNull(), 1.0).when(F.col("_margin") >= 2, 0.9).when(F.col("_margin") == 1, 0.75).otherwise(0.6)
    return counted.select(*COMMIT, F.col("branch").alias("branch_name"), F.lit("task_branch").alias("source"), F.lit(0).alias("is_fallback"), "candidate_count", F.col("distance").alias("distance_to_tip"), confidence.alias("confidence"))


def fallback(branch_commits: DataFrame) -> DataFrame:
    """The first integration branch, in a fixed order, that holds the commit."""
    place = F.array_position(F.array(*map(F.lit, C.FALLBACK_ORDER)), F.col("branch"))
    best = branch_commits.withColumn("_place", place).filter("_place > 0").groupBy(*COMMIT).agg(F.min(F.struct("_place", "branch", "distance")).alias("b"))
    return best.select(*COMMIT, F.col("b.branch").alias("branch_name"), F.col("b.distance").alias("distance_to_tip"))


def assigned(commits: DataFrame, branch_commits: DataFrame) -> DataFrame:
    """One row for each commit: its branch and task, how they were found and how sure that is."""
    first = primary(branch_commits)
    rest = commits.select(*COMMIT).distinct().join(first, COMMIT, "left_anti").join(fallback(branch_commits), COMMIT, "left")
    second = rest.select(
        *COMMIT, F.coalesce("branch_name", F.lit(C.UNKNOWN)).alias("branch_name"), F.lit("integration_fallback").alias("source"), F.lit(1).alias("is_fallback"), F.lit(0).cast("bigint").alias("candidate_count"),
        "distance_to_tip", F.when(F.col("branch_name").isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
    )
    return first.unionByName(second).withColumn("task_key", C.task_key(F.col("branch_name")))
