"""The reporting bases: lazy joins over the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.functions import columns as C

SESSION = ["provider", "session_id"]
COMMIT = ["repo_root", "commit_sha"]
WINDOW_HOURS = 4


def within_window(commit_time: Column, started: Column, ended: Column) -> Column:
    """Whether a commit falls between a session's start and four hours after its end."""
    end = F.coalesce(ended, started).cast("timestamp") + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")
    inside = (commit_time.cast("timestamp") >= started.cast("timestamp")) & (commit_time.cast("timestamp") <= end)
    return F.coalesce(inside, F.lit(False)).cast("int")


def session_metrics(quality: DataFrame, productivity: DataFrame) -> DataFrame:
    sq, ep = quality.alias("sq"), productivity.alias("ep")
    model = F.coalesce(C.blank_to_null(F.col("sq.model_name")), C.blank_to_null(F.col("ep.model_name")))
    started = F.coalesce("sq.started_at", "ep.started_at")
    return sq.join(ep, SESSION, "left").select(
        *SESSION,
        F.coalesce("sq.repo_root", "ep.repo_root", F.lit(C.UNKNOWN)).alias("repo_root"),
        C.normalized_model(F.col("provider"), model).alias("model_name"),
        started.alias("started_at"),
        C.week_start(started).alias("week_start"),
        "sq.user_turn_count",
        "sq.debug_loop_flag",
        "sq.mid_session_error_paste_flag",
        F.coalesce("sq.accepted_output_flag", F.lit(0)).alias("accepted_output_flag"),
        "sq.first_accepted_change_at",
        "sq.minutes_to_first_accepted_change",
        F.coalesce("sq.session_commit_within_4h_flag", F.lit(0)).alias("session_commit_within_4h_flag"),
    )


def task_session_metrics(task_session: DataFrame) -> DataFrame:
    return (
        task_session.withColumn("model_name", C.normalized_model(F.col("provider"), F.col("model_name")))
        .withColumn("week_start", C.week_start(F.col("started_at")))
        .withColumn("accepted_output_flag", F.coalesce("accepted_output_flag", F.lit(0)))
    )


def collapsed_sessions(task_commit: DataFrame, commit_session: DataFrame, quality: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Sessions behind the commits of a task or branch, one row for each, with the sum of their lines as weight."""
    cs = commit_session.select(*COMMIT, *SESSION, F.col("model_name").alias("_model"), "matched_lines", F.col("commit_time").alias("_at"))
    joined = task_commit.drop("commit_time").join(cs, COMMIT).join(quality.drop("repo_root", "model_name"), SESSION, "left")
    top = lambda c: F.max(c).alias(c)
    return joined.groupBy(*keys, *SESSION).agg(
        *more,
        F.max("_model").alias("model_name"),
        top("started_at"),
        F.sum("matched_lines").alias("attribution_weight"),
        *[top(c) for c in ("user_turn_count", "debug_loop_flag", "mid_session_error_paste_flag", "accepted_output_flag", "first_accepted_change_at", "minutes_to_first_accepted_change")],
        F.max(within_window(F.col("_at"), F.col("started_at"), F.col("ended_at"))).alias("commit_within_window_flag"),
    )


def branch_session_metrics(task_commit: DataFrame, commit_session: DataFrame, quality: DataFrame) -> DataFrame:
    return task_session_metrics(collapsed_sessions(task_commit, commit_session, quality, ["repo_root", "branch_name"]))


def commit_facts(outcome: DataFrame, churn: DataFrame, bug: DataFrame, how: str = "inner") -> DataFrame:
    """Outcome, churn and bug signal of each commit."""
    o = outcome.select(*COMMIT, F.col("commit_time").alias("_outcome_time"), "heavy_ai_flag", "merged_to_mainline_flag", "reverted_later_flag", "commit_total_changed_lines")
    c = churn.select(*COMMIT, "ai_added_lines_reaching_mainline", "ai_added_lines_removed_within_window")
    b = bug.select(*COMMIT, "bug_after_merge_flag", "bug_signal_count", "first_bug_signal_commit_sha", "first_bug_signal_commit_time")
    return o.join(c, COMMIT, how).join(b, COMMIT, "left")


def no_signal_as_zero(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bug_after_merge_flag", "bug_signal_count")})


def change_metrics(outcome: DataFrame, churn: DataFrame, bug: DataFrame) -> DataFrame:
    rows = no_signal_as_zero(commit_facts(outcome, churn, bug)).withColumnRenamed("_outcome_time", "commit_time")
    return rows.withColumn("week_start", C.week_start(F.col("commit_time")))


def commit_session_metrics(commit_session: DataFrame, outcome: DataFrame, churn: DataFrame, bug: DataFrame) -> DataFrame:
    cs = commit_session.select(*COMMIT, *SESSION, C.normalized_model(F.col("provider"), F.col("model_name")).alias("model_name"), "commit_time", "matched_lines", "share_of_commit", "share_of_ai")
    joined = no_signal_as_zero(cs.join(commit_facts(outcome, churn, bug).drop("_outcome_time"), COMMIT))
    return joined.withColumn("week_start", C.week_start(F.col("commit_time")))


def task_commit_metrics(task_commit: DataFrame, outcome: DataFrame, churn: DataFrame, bug: DataFrame) -> DataFrame:
    tc = task_commit.select("repo_root", "task_key", "branch_name", "commit_sha", "fallback_flag", "confidence", "commit_time")
    joined = no_signal_as_zero(tc.join(commit_facts(outcome, churn, bug, "left").drop("_outcome_time"), COMMIT, "left"))
    return joined.withColumn("week_start", C.week_start(F.col("commit_time")))


def branch_commit_metrics(task_commit: DataFrame, outcome: DataFrame, churn: DataFrame, bug: DataFrame) -> DataFrame:
    return task_commit_metrics(task_commit, outcome, churn, bug).drop("task_key")


def session_productivity(productivity: DataFrame) -> DataFrame:
    return productivity.select(
        "provider",
        C.normalized_model(F.col("provider"), F.col("model_name")).alias("model_name"),
        "session_id",
        F.coalesce("repo_root", F.lit(C.UNKNOWN)).alias("repo_root"),
        C.or_unknown(F.col("project_path")).alias("project_path"),
        F.coalesce("ended_at", "started_at").alias("last_active"),
        "user_word_count",
        F.col("accepted_total_changed_lines").alias("total_loc"),
        F.col("accepted_lines_added").alias("total_added"),
        F.col("accepted_lines_removed").alias("total_removed"),
    )
