"""Materialization of the event tables from facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.functions import columns as C
from agentlens.operators import attribution, conversation, outcomes
from agentlens.operators.tables import written
from agentlens.plans import views as V

SESSION = V.SESSION
COMMIT = V.COMMIT


def signals(sessions: DataFrame, messages: DataFrame, changes: DataFrame) -> DataFrame:
    """What each session's own rows and its messages and changes say, one row for each session that says anything."""
    words = conversation.user_words(messages)
    accepted = changes.filter(F.col("source_kind") == "accepted_change")
    lines = accepted.groupBy(*SESSION).agg(F.sum("lines_added").alias("added_lines"), F.sum("lines_removed").alias("removed_lines"))
    real = F.col("source_kind").isin("accepted_change", "tool_write") & ((F.col("lines_added") > 0) | (F.col("lines_removed") > 0))
    output = changes.groupBy(*SESSION).agg(F.min(F.when(real, F.col("change_ts"))).alias("first_accepted_change_at"), F.max(real.cast("int")).alias("accepted_output_flag"))
    times = messages.select(*SESSION, F.col("message_ts").alias("ts")).unionByName(accepted.select(*SESSION, F.col("change_ts").alias("ts"))).filter(F.col("ts").isNotNull())
    bounds = times.groupBy(*SESSION).agg(F.min("ts").alias("min_signal_ts"), F.max("ts").alias("max_signal_ts"))
    joined = sessions
    for part in (words, lines, output, bounds):
        joined = joined.join(part, SESSION, "left")
    told = [F.col(c).isNotNull() for c in ("started_at", "user_word_count", "added_lines", "removed_lines", "accepted_output_flag")]
    return joined.filter(told[0] | told[1] | told[2] | told[3] | told[4])


def timed_signals(sessions: DataFrame, messages: DataFrame, changes: DataFrame) -> DataFrame:
    """`signals` with the times that they and the session's own rows give: _begin, _end, _first, _last."""
    begin = F.coalesce("started_at", "min_signal_ts")
    last = F.when(F.col("provider") == "cursor", F.coalesce("max_signal_ts", "ended_at", "started_at")).otherwise(F.coalesce("max_signal_ts", "started_at"))
    timed = signals(sessions, messages, changes).withColumn("_begin", begin).withColumn("_last", last).withColumn("_first", F.coalesce("min_signal_ts", "started_at"))
    return timed.withColumn("_end", F.coalesce("ended_at", "started_at", "_last", "_first"))


def session_events(sessions: DataFrame, messages: DataFrame, changes: DataFrame, matches: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """event_session_quality and event_session_productivity; `matches` gives (SESSION, commit_time) of attributed commits for
    (SESSION, _begin, _end), of these spans or more."""
    timed = timed_signals(sessions, messages, changes)
    spans = timed.select(*SESSION, "_begin", "_end")
    hits = matches(spans).join(spans, SESSION).filter(V.within_window(F.col("commit_time"), F.col("_begin"), F.col("_end")) == 1).select(*SESSION, F.lit(1).alias("_hit")).distinct()
    told = timed.join(hits, SESSION, "left").withColumn("model_name", C.normalized_model(F.col("provider"), F.col("model_name")))
    minutes = C.minutes_between(F.col("first_accepted_change_at"), F.col("_begin"))
    quality = told.join(conversation.summaries(messages), SESSION).select(
        *SESSION, "repo_root", "model_name", "started_at", "ended_at", "user_turn_count", "debug_loop_flag", "mid_session_error_paste_flag",
        F.coalesce("accepted_output_flag", F.lit(0)).alias("accepted_output_flag"), "first_accepted_change_at", minutes.alias("minutes_to_first_accepted_change"),
        F.coalesce("_hit", F.lit(0)).alias("session_commit_within_4h_flag"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    productivity = told.select(
        *SESSION, "repo_root", "model_name", C.or_unknown(F.col("project_path")).alias("project_path"), F.col("_first").alias("started_at"), F.col("_last").alias("ended_at"),
        zero("added_lines").alias("accepted_lines_added"), zero("removed_lines").alias("accepted_lines_removed"),
        (zero("added_lines") + zero("removed_lines")).alias("accepted_total_changed_lines"), zero("user_word_count").alias("user_word_count"),
    )
    return quality, productivity


class CommitEvents(Mapping):
    """commit, outcome, churn, bug, commit_session and rejected by name; what a table needs is computed when it is first asked for."""

    NAMES = ("commit", "outcome", "churn", "bug", "commit_session", "rejected")

    def __init__(self, commits: DataFrame, commit_rows: DataFrame, session_rows: DataFrame, sessions: DataFrame, mainline: DataFrame, merges: DataFrame, extra_signals: DataFrame | None):
        self._commits, self._commit_rows, self._session_rows, self._sessions, self._mainline, self._merges, self._extra_signals = commits, commit_rows, session_rows, sessions, mainline, merges, extra_signals

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, f"_{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    @cached_property
    def _plain(self) -> DataFrame:
        return self._commits.join(self._merges.select(*COMMIT), COMMIT, "left_anti")

    @cached_property
    def _rejected(self) -> DataFrame:
        return self._commits.join(self._merges.select(*COMMIT), COMMIT, "left_semi").select(*COMMIT, "commit_time", F.lit("merge commit").alias("reason"))

    @cached_property
    def _matched(self) -> attribution.Matched:
        return attribution.Matched(self._commit_rows, self._session_rows)

    @cached_property
    def _commit(self) -> DataFrame:
        return attribution.commit_facts(self._matched)

    @cached_property
    def _budget(self) -> DataFrame:
        return written(attribution.ai_budget(self._commit_rows, self._session_rows).join(self._plain.select(*COMMIT, "commit_time"), attribution.BY_COMMIT).select(*attribution.FILE, "line_hash", "budget", "commit_time"))

    @cached_property
    def _on_main(self) -> DataFrame:
        bounds = self._commits.groupBy("repo_root").agg(F.min("commit_time").alias("_low"), (F.max("commit_time") + outcomes.days(outcomes.CHURN_DAYS)).alias("_high"))
        times = self._mainline.select(*COMMIT, F.col("commit_time").alias("event_time")).join(bounds, "repo_root").filter(F.col("event_time").between(F.col("_low"), F.col("_high")))
        return self._commit_rows.join(times.select(*COMMIT, "event_time"), attribution.BY_COMMIT)

    @cached_property
    def _derived(self) -> DataFrame:
        derived = outcomes.outcomes(self._plain.join(self._commit, COMMIT), self._budget, self._on_main.filter("side = '+'"), self._mainline, outcomes.revert_times(self._commits))
        return written(derived.select(
            *COMMIT, "commit_time", F.col("heavy_ai").alias("heavy_ai_flag"), "merged_to_mainline_flag", "reverted_later_flag", (F.col("total_added") + F.col("total_removed")).alias("commit_total_changed_lines"),
            "matched_total_lines", "ai_added_lines_reaching_mainline",
        ))

    @cached_property
    def _outcome(self) -> DataFrame:
        return self._derived.drop("ai_added_lines_reaching_mainline")

    @cached_property
    def _churn(self) -> DataFrame:
        lost = outcomes.churn(self._budget, self._on_main.filter("side = '-'"), self._derived.filter("merged_to_mainline_flag = 1"))
        return self._derived.select(*COMMIT, "ai_added_lines_reaching_mainline").join(lost, COMMIT, "left").fillna(0, ["ai_added_lines_removed_within_window"]).withColumn("window_days", F.lit(outcomes.CHURN_DAYS))

    @cached_property
    def _bug(self) -> DataFrame:
        heavy = self._derived.filter("merged_to_mainline_flag = 1 AND heavy_ai_flag = 1").select(*COMMIT)
        signals = outcomes.fix_signals(self._commits, self._commit_rows)
        if self._extra_signals is not None:
            signals = signals.unionByName(self._extra_signals.select(*signals.columns))
        return outcomes.bugs_after(self._budget.join(heavy, attribution.BY_COMMIT, "left_semi"), signals)

    @cached_property
    def _commit_session(self) -> DataFrame:
        shares = attribution.session_shares(self._matched, self._commit, self._plain.select(*COMMIT, "commit_time"), self._sessions.select(*SESSION, "model_name"))
        return shares.withColumn("model_name", C.normalized_model(F.col("provider"), F.col("model_name")))


def commit_events(commits: DataFrame, commit_rows: DataFrame, session_rows: DataFrame, sessions: DataFrame, mainline: DataFrame, merges: DataFrame, extra_signals: DataFrame | None = None) -> CommitEvents:
    """outcome, churn, bug and commit_session; merges have no events and are returned as `rejected`, for the caller to report.

    Mainline events run from the first commit to 14 days after the last one of a repository.
    """
    return CommitEvents(commits, commit_rows, session_rows, sessions, mainline, merges, extra_signals)


def task_commits(assignments: DataFrame, commits: DataFrame) -> DataFrame:
    """event_task_commit."""
    return assignments.join(commits.select(*COMMIT, "commit_time"), COMMIT).select("repo_root", "task_key", "commit_sha", "branch_name", F.col("is_fallback").alias("fallback_flag"), "confidence", "commit_time")


def task_sessions(task_commit: DataFrame, commit_session: DataFrame, quality: DataFrame) -> DataFrame:
    """event_task_session: a task can span branches; the first name stands for them."""
    return V.collapsed_sessions(task_commit, commit_session, quality, ["repo_root", "task_key"], F.min("branch_name").alias("branch_name"))
