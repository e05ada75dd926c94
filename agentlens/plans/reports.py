"""The session, delivery and quality reports and the session list."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.functions import columns as C
from agentlens.plans import views as V

GROUPS = {"repo": "repo_root", "provider": "provider", "task": "task_key", "branch": "branch_name", "model": "model_name"}
MIN_SAMPLE = 3
HUMAN = "human/(unknown)"


@dataclass(frozen=True)
class ReportArgs:
    """What a report is asked for; a filter that the chosen base can't apply is ignored."""

    group_by: str | None = None
    weekly: bool = False
    repo: str | None = None
    provider: str | None = None
    task: str | None = None
    branch: str | None = None
    model: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    limit: int = 50
    implicit_model: bool = False

    def needs_task(self) -> bool:
        return self.group_by == "task" or self.task is not None

    def needs_branch(self) -> bool:
        return not self.needs_task() and (self.group_by == "branch" or self.branch is not None)

    def needs_sessions(self) -> bool:
        return self.group_by in ("provider", "model") or self.provider is not None or self.model is not None


@dataclass(frozen=True)
class Events:
    """The event tables; `pr_lookup`, `pr_outcome` and `commit` only matter to the delivery report."""

    quality: DataFrame
    productivity: DataFrame
    outcome: DataFrame
    churn: DataFrame
    bug: DataFrame
    commit_session: DataFrame
    task_commit: DataFrame
    task_session: DataFrame
    pr_lookup: DataFrame | None = None
    pr_outcome: DataFrame | None = None
    commit: DataFrame | None = None


def filtered(df: DataFrame, args: ReportArgs, time: str) -> DataFrame:
    """The conjunction of the filters that the columns of `df` allow."""
    for name, value in (("repo_root", args.repo), ("provider", args.provider), ("task_key", args.task), ("branch_name", args.branch)):
        if value is not None and name in df.columns:
            df = df.filter(F.col(name) == value)
    if args.model is not None and "model_name" in df.columns:
        df = df.filter(F.coalesce("model_name", F.lit(C.UNKNOWN)) == args.model)
    day = F.col(time).cast("date")
    if args.date_from is not None:
        df = df.filter(day >= F.lit(args.date_from).try_cast("date"))
    if args.date_to is not None:
        df = df.filter(day <= F.lit(args.date_to).try_cast("date"))
    return df


def grouping(args: ReportArgs) -> list[Column]:
    """week_start, group_value and branch_name; null where the report isn't cut that way."""
    null = F.lit(None).cast("string")
    week = F.col("week_start").cast("string") if args.weekly else null
    value = F.col(GROUPS[args.group_by]) if args.group_by else null
    branch = F.col("branch_name") if args.group_by == "task" else null
    return [week.alias("week_start"), value.alias("group_value"), branch.alias("branch_name")]


def aggregated(df: DataFrame, keys: list[Column], measures: list[Column]) -> DataFrame:
    names = ["week_start", "group_value", "branch_name"]
    return df.withColumns({f"_{n}": k for n, k in zip(names, keys)}).groupBy(*[F.col(f"_{n}").alias(n) for n in names]).agg(*measures)


def over_nothing(df: DataFrame, args: ReportArgs, zeros: list[str]) -> DataFrame:
    """The row of an overall report over no rows."""
    if args.group_by or args.weekly:
        return df
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(df.withColumn("_one", F.lit(1)), "_one", "left").drop("_one").fillna(0, zeros)


def finished(df: DataFrame, args: ReportArgs, keep: Column, order: list[Column]) -> DataFrame:
    """Order, limit and the rules of task reports and of the implicit grouping by model."""
    limit = max(args.limit, 1)
    natural = [F.col("week_start"), C.natural_task_key(F.col("group_value")), F.coalesce("branch_name", F.lit(""))]
    if args.group_by == "task":
        # the limit counts in the order of the keys as strings; the rows that it leaves are then put in natural order
        named = df.filter(C.is_reportable_key(F.col("group_value")) & ~F.coalesce(F.col("branch_name"), F.lit("")).isin(*C.REPORT_INTEGRATION))
        return named.orderBy("week_start", "group_value", "branch_name").limit(limit).orderBy(*natural)
    if args.implicit_model and args.group_by == "model":
        if args.weekly:
            return df.orderBy("week_start", "group_value")
        told = df.withColumn("_keep", keep)
        some = told.agg(F.coalesce(F.max("_keep"), F.lit(False)).alias("_any"))  # one row
        chosen = told.join(F.broadcast(some), F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")
        return chosen.orderBy(*order).limit(limit)
    ordered = df.orderBy("week_start", "group_value")
    return ordered.limit(limit) if args.group_by or args.weekly else ordered


def session_base(e: Events, args: ReportArgs) -> DataFrame:
    if args.needs_task():
        return V.task_session_metrics(e.task_session)
    if args.needs_branch():
        return V.branch_session_metrics(e.task_commit, e.commit_session, e.quality)
    return V.session_metrics(e.quality, e.productivity)


def session_report(e: Events, args: ReportArgs) -> DataFrame:
    weighted = args.needs_task() or args.needs_branch()
    base = filtered(session_base(e, args), args, "started_at")
    w = F.when(F.col("attribution_weight") > 0, F.col("attribution_weight")).otherwise(1.0) if weighted else F.lit(1)
    committed = F.col("commit_within_window_flag" if weighted else "session_commit_within_4h_flag")
    whole = C.rounded if weighted else (lambda c: F.coalesce(c, F.lit(0)).cast("bigint"))
    count = lambda test: whole(F.sum(F.when(test, w).otherwise(F.lit(0))))
    mean = lambda c: F.sum(w * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0))
    told = F.col("user_turn_count").isNotNull()
    measures = [
        F.count("*").alias("session_count"),
        mean("user_turn_count").cast("double").alias("avg_prompts"),
        mean("minutes_to_first_accepted_change").cast("double").alias("avg_minutes_to_first_change"),
        count(F.col("debug_loop_flag") == 1).alias("loop_n"),
        count(F.col("debug_loop_flag").isNotNull()).alias("loop_d"),
        count(F.col("mid_session_error_paste_flag") == 1).alias("error_n"),
        count(F.col("mid_session_error_paste_flag").isNotNull()).alias("error_d"),
        count(committed == 1).alias("commit_n"),
        count(committed.isNotNull()).alias("commit_d"),
        count(told & (F.col("accepted_output_flag") == 0)).alias("no_output_n"),
        count(told).alias("no_output_d"),
    ]
    rows = aggregated(base, grouping(args), measures).filter("session_count > 0")
    share = F.coalesce(C.percent(F.col("no_output_n"), F.col("no_output_d")), F.lit(-1.0))
    return finished(rows, args, F.col("session_count") >= MIN_SAMPLE, [F.desc("session_count"), share.desc(), F.col("group_value")])


def commit_base(e: Events, args: ReportArgs) -> tuple[DataFrame, bool]:
    """The base of delivery and quality reports, and whether it has a row for each session of a commit."""
    if args.needs_task() or args.needs_branch():
        view = V.task_commit_metrics if args.needs_task() else V.branch_commit_metrics
        base = filtered(view(e.task_commit, e.outcome, e.churn, e.bug), args, "commit_time")
        if args.provider is None and args.model is None:
            return base, False
        cs = e.commit_session.withColumn("model_name", C.normalized_model(F.col("provider"), F.col("model_name")))
        return base.join(filtered(cs, ReportArgs(provider=args.provider, model=args.model), "commit_time").select(*V.COMMIT).distinct(), V.COMMIT, "left_semi"), False
    if args.needs_sessions():
        return filtered(V.commit_session_metrics(e.commit_session, e.outcome, e.churn, e.bug), args, "commit_time"), True
    return filtered(V.change_metrics(e.outcome, e.churn, e.bug), args, "commit_time"), False


def delivery_report(e: Events, args: ReportArgs) -> DataFrame:
    base, by_session = commit_base(e, args)
    keys = e.outcome.select(*V.COMMIT, "repo_key")
    lookup = e.pr_lookup.select("repo_key", "commit_sha", F.col("status").alias("_status"))
    pr = e.pr_outcome.select(*V.COMMIT, "pr_opened_flag", "pr_merged_flag")
    lines = e.commit.select(*V.COMMIT, "total_added", "total_removed")
    rows = base.join(keys, V.COMMIT, "left").join(lookup, ["repo_key", "commit_sha"], "left").join(pr, V.COMMIT, "left").join(lines, V.COMMIT, "left")
    heavy, hosted = F.col("heavy_ai_flag") == 1, F.lower("repo_key").startswith("git:github.com/")
    merged, opened = F.col("merged_to_mainline_flag") == 1, F.col("pr_opened_flag") == 1
    shas = lambda test: F.countDistinct(F.when(test, F.col("commit_sha")))
    number = shas if by_session else (lambda test: F.count(F.when(test, 1)))
    measures = [
        (F.countDistinct("commit_sha") if by_session else F.count("*")).alias("commit_count"),
        number(heavy).alias("heavy_commit_count"),
        number(heavy & merged).alias("mainline_n"),
        number(heavy).alias("mainline_d"),
        shas(heavy & hosted).alias("pr_eligible"),
        shas(heavy & hosted & F.col("_status").isin("resolved", "no_pr")).alias("pr_ready"),
        shas(heavy & hosted & opened).alias("pr_reach_n"),
        shas(heavy & hosted & opened & (F.col("pr_merged_flag") == 1)).alias("pr_merge_n"),
        F.coalesce(F.sum("total_added"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("total_removed"), F.lit(0)).alias("lines_removed"),
    ]
    group = grouping(args)
    found = aggregated(rows, group, measures)
    found = over_nothing(found, args, [c for c in found.columns if c not in ("week_start", "group_value", "branch_name")])
    share = F.coalesce(C.percent(F.col("mainline_n"), F.col("mainline_d")), F.lit(-1.0))
    keep = (F.col("heavy_commit_count") >= MIN_SAMPLE) & ~F.col("group_value").eqNullSafe(HUMAN)
    return finished(found, args, keep, [F.desc("heavy_commit_count"), share.asc(), F.col("group_value")])


def quality_report(e: Events, args: ReportArgs) -> DataFrame:
    base, by_session = commit_base(e, args)
    heavy, merged = F.col("heavy_ai_flag") == 1, F.col("merged_to_mainline_flag") == 1
    share = F.col("share_of_ai") if by_session else F.lit(1)
    whole = C.rounded if by_session else (lambda c: F.coalesce(c, F.lit(0)).cast("bigint"))
    total = lambda test, value: whole(F.sum(F.when(test, value).otherwise(F.lit(0))))
    measures = [
        (F.countDistinct(F.when(heavy, F.col("commit_sha"))) if by_session else F.count(F.when(heavy, 1))).alias("heavy_commit_count"),
        total(heavy, share * F.col("ai_added_lines_removed_within_window")).alias("churn_n"),
        total(heavy, share * F.col("ai_added_lines_reaching_mainline")).alias("churn_d"),
        total(heavy & merged & (F.col("bug_after_merge_flag") == 1), share).alias("bug_n"),
        total(heavy & merged, share).alias("bug_d"),
        total(heavy & (F.col("reverted_later_flag") == 1), share).alias("revert_n"),
        total(heavy, share).alias("revert_d"),
    ]
    found = aggregated(base, grouping(args), measures)
    found = over_nothing(found, args, [c for c in found.columns if c not in ("week_start", "group_value", "branch_name")])
    worst = F.coalesce(C.percent(F.col("bug_n"), F.col("bug_d")), F.lit(-1.0))
    keep = (F.col("heavy_commit_count") >= MIN_SAMPLE) & ~F.col("group_value").eqNullSafe(HUMAN)
    return finished(found, args, keep, [F.desc("heavy_commit_count"), worst.desc(), F.col("group_value")])


def session_list(e: Events, args: ReportArgs) -> DataFrame:
    """The latest sessions."""
    rows = filtered(V.session_productivity(e.productivity), ReportArgs(repo=args.repo, provider=args.provider, model=args.model, date_from=args.date_from, date_to=args.date_to), "last_active")
    if args.task is not None:
        rows = rows.join(e.task_session.filter(F.col("task_key") == args.task), V.SESSION, "left_semi")
    if args.branch is not None:
        branch = V.branch_session_metrics(e.task_commit, e.commit_session, e.quality)
        rows = rows.join(branch.filter(F.col("branch_name") == args.branch), V.SESSION, "left_semi")
    return rows.orderBy(F.desc_nulls_last("last_active"), "provider", "session_id").limit(max(args.limit, 1))


def hidden_branches(e: Events, args: ReportArgs) -> DataFrame:
    """(hint): one row if a session report by task has none although the same report by branch has some, else none."""
    if args.group_by != "task" or args.task is not None:
        return e.quality.sparkSession.createDataFrame([], "hint string")
    by_branch = session_report(e, replace(args, group_by="branch", limit=1)).select(F.lit("no branch names a task; group by branch instead").alias("hint"))
    any_task = session_report(e, replace(args, limit=1)).agg(F.count("*").alias("_n"))  # one row
    return by_branch.limit(1).join(F.broadcast(any_task), F.col("_n") == 0).select("hint")
