"""The registered queries over the engine's relations, and the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlens.functions import columns as C
from agentlens.functions import hashing
from agentlens.operators import attribution, branches, conversation, incremental, outcomes
from agentlens.operators.tables import own_folder, shared_folder, written
from agentlens.plans import events, refresh, reports, scorecards, stream, views
from agentlens.sources.adapter import prelude, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Read = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a function of a reader of relations; `sql` follows the relations that it uses."""

    def register(build: Callable[[Read], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda r: relation(spark, sf_dir, r) if r != "documents" else spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if sql is not None:
            chain = prelude(*uses) if uses else ""
            SQL[name] = f"{chain},\n{sql[5:]}" if chain and sql.startswith("WITH ") else f"{chain}\n{sql}"
        return build

    return register


def nm(p: str, m: str) -> str:
    return f"CASE WHEN nullif(trim({m}, ' '), '') IS NULL THEN {p} || '/(unknown)' WHEN starts_with(lower({m}), lower({p} || '/')) THEN {m} ELSE {p} || '/' || {m} END"


def week(t: str) -> str:
    return f"CAST(CAST(date_trunc('week', {t}) AS DATE) AS VARCHAR)"


def as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("week_start", F.col("week_start").cast("string"))


class EventTables:
    """The event tables by name, each read when a report first asks for it."""

    def __init__(self, read: Read):
        self._read = read

    def __getattr__(self, name: str) -> DataFrame:
        table = self._read("pr_lookups" if name == "pr_lookup" else f"ev_{name}")
        setattr(self, name, table)
        return table


def event_tables(read: Read) -> EventTables:
    return EventTables(read)


# ---- views

V1 = f"""SELECT sq.provider, sq.session_id, coalesce(sq.repo_root, ep.repo_root, '(unknown)') AS repo_root, {nm("sq.provider", "coalesce(nullif(trim(sq.model_name, ' '), ''), nullif(trim(ep.model_name, ' '), ''))")} AS model_name,
    coalesce(sq.started_at, ep.started_at) AS started_at, {week("coalesce(sq.started_at, ep.started_at)")} AS week_start, sq.user_turn_count, sq.debug_loop_flag, sq.mid_session_error_paste_flag,
    coalesce(sq.accepted_output_flag, 0) AS accepted_output_flag, sq.first_accepted_change_at, sq.minutes_to_first_accepted_change, coalesce(sq.session_commit_within_4h_flag, 0) AS session_commit_within_4h_flag
    FROM ev_quality sq LEFT JOIN ev_productivity ep ON ep.provider = sq.provider AND ep.session_id = sq.session_id"""
V2 = f"""SELECT repo_root, task_key, branch_name, provider, session_id, {nm("provider", "model_name")} AS model_name, started_at, {week("started_at")} AS week_start, attribution_weight, user_turn_count, debug_loop_flag,
    mid_session_error_paste_flag, coalesce(accepted_output_flag, 0) AS accepted_output_flag, first_accepted_change_at, minutes_to_first_accepted_change, commit_within_window_flag FROM ev_task_session"""
V3 = f"""SELECT repo_root, branch_name, provider, session_id, {nm("provider", "m")} AS model_name, started_at, {week("started_at")} AS week_start, attribution_weight, user_turn_count, debug_loop_flag,
    mid_session_error_paste_flag, coalesce(accepted, 0) AS accepted_output_flag, first_accepted_change_at, minutes_to_first_accepted_change, commit_within_window_flag FROM (
        SELECT t.repo_root, t.branch_name, s.provider, s.session_id, max(s.model_name) AS m, max(q.started_at) AS started_at, sum(s.matched_lines) AS attribution_weight, max(q.user_turn_count) AS user_turn_count,
        max(q.debug_loop_flag) AS debug_loop_flag, max(q.mid_session_error_paste_flag) AS mid_session_error_paste_flag, max(q.accepted_output_flag) AS accepted, max(q.first_accepted_change_at) AS first_accepted_change_at,
        max(q.minutes_to_first_accepted_change) AS minutes_to_first_accepted_change,
        max(CASE WHEN s.commit_time >= q.started_at AND s.commit_time <= coalesce(q.ended_at, q.started_at) + INTERVAL 4 HOUR THEN 1 ELSE 0 END) AS commit_within_window_flag
        FROM ev_task_commit t JOIN ev_commit_session s ON s.repo_root = t.repo_root AND s.commit_sha = t.commit_sha LEFT JOIN ev_quality q ON q.provider = s.provider AND q.session_id = s.session_id
        GROUP BY t.repo_root, t.branch_name, s.provider, s.session_id)"""
FACTS = """o.heavy_ai_flag, o.merged_to_mainline_flag, o.reverted_later_flag, o.commit_total_changed_lines, c.ai_added_lines_reaching_mainline, c.ai_added_lines_removed_within_window,
    coalesce(b.bug_after_merge_flag, 0) AS bug_after_merge_flag, coalesce(b.bug_signal_count, 0) AS bug_signal_count, b.first_bug_signal_commit_sha, b.first_bug_signal_commit_time"""


def facts_join(of: str, how: str) -> str:
    return f"{how} ev_churn c ON c.repo_root = {of}.repo_root AND c.commit_sha = {of}.commit_sha LEFT JOIN ev_bug b ON b.repo_root = {of}.repo_root AND b.commit_sha = {of}.commit_sha"


V4 = f"SELECT o.repo_root, o.commit_sha, o.commit_time, {week('o.commit_time')} AS week_start, {FACTS} FROM ev_outcome o {facts_join('o', 'JOIN')}"
V5 = f"""SELECT s.repo_root, s.commit_sha, s.provider, s.session_id, {nm("s.provider", "s.model_name")} AS model_name, s.commit_time, {week("s.commit_time")} AS week_start, s.matched_lines, s.share_of_commit, s.share_of_ai, {FACTS}
    FROM ev_commit_session s JOIN ev_outcome o ON o.repo_root = s.repo_root AND o.commit_sha = s.commit_sha {facts_join("s", "JOIN")}"""
V6 = f"SELECT t.repo_root, t.task_key, t.branch_name, t.commit_sha, t.fallback_flag, t.confidence, t.commit_time, {week('t.commit_time')} AS week_start, {FACTS} FROM ev_task_commit t LEFT JOIN ev_outcome o ON o.repo_root = t.repo_root AND o.commit_sha = t.commit_sha {facts_join('t', 'LEFT JOIN')}"
V7 = V6.replace("t.task_key, ", "")
V8 = f"""SELECT provider, {nm("provider", "model_name")} AS model_name, session_id, coalesce(repo_root, '(unknown)') AS repo_root, coalesce(nullif(trim(project_path, ' '), ''), '(unknown)') AS project_path,
    coalesce(ended_at, started_at) AS last_active, user_word_count, accepted_total_changed_lines AS total_loc, accepted_lines_added AS total_added, accepted_lines_removed AS total_removed FROM ev_productivity"""
COMMIT_EVENTS = ("ev_outcome", "ev_churn", "ev_bug", "ev_commit_session", "ev_task_commit", "ev_quality", "ev_productivity", "ev_task_session", "pr_lookups", "ev_pr_outcome", "ev_commit")


def view(name: str, sql: str, build: Callable[[reports.Events], DataFrame], text: bool = True) -> None:
    query(name, sql, COMMIT_EVENTS)(lambda read: as_text(build(event_tables(read))) if text else build(event_tables(read)))


view("v1_session_metrics", V1, lambda e: views.session_metrics(e.quality, e.productivity))
view("v2_task_session_metrics", V2, lambda e: views.task_session_metrics(e.task_session))
view("v3_branch_session_metrics", V3, lambda e: views.branch_session_metrics(e.task_commit, e.commit_session, e.quality))
view("v4_change_metrics", V4, lambda e: views.change_metrics(e.outcome, e.churn, e.bug))
view("v5_commit_session_metrics", V5, lambda e: views.commit_session_metrics(e.commit_session, e.outcome, e.churn, e.bug))
view("v6_task_commit_metrics", V6, lambda e: views.task_commit_metrics(e.task_commit, e.outcome, e.churn, e.bug))
view("v7_branch_commit_metrics", V7, lambda e: views.branch_commit_metrics(e.task_commit, e.outcome, e.churn, e.bug))
view("v8_session_productivity", V8, lambda e: views.session_productivity(e.productivity), text=False)

# ---- reports: means are rounded to 6 places

NULLS = "CAST(NULL AS VARCHAR)"


def group_sql(week_: bool, value: str | None, branch: bool = False) -> tuple[str, str]:
    cols = f"{'week_start' if week_ else NULLS} AS week_start, {value or NULLS} AS group_value, {'branch_name' if branch else NULLS} AS branch_name"
    by = [c for c, on in (("week_start", week_), (value, value), ("branch_name", branch)) if on]
    return cols, f"GROUP BY {', '.join(by)}" if by else ""


def session_sql(base: str, week_: bool, value: str | None, weighted: bool, branch: bool = False, where: str = "true") -> str:
    cols, by = group_sql(week_, value, branch)
    w = "CASE WHEN attribution_weight > 0 THEN attribution_weight ELSE 1 END" if weighted else "1"
    n = (lambda test: f"CAST(round(sum(CASE WHEN {test} THEN {w} ELSE 0 END), 0) AS BIGINT)") if weighted else (lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)")
    mean = lambda c: f"round(sum(CASE WHEN {c} IS NOT NULL THEN {w} * CAST({c} AS DOUBLE) END) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN {w} END), 0), 6)"
    committed = "commit_within_window_flag" if weighted else "session_commit_within_4h_flag"
    return f"""SELECT {cols}, count(*) AS session_count, {mean("user_turn_count")} AS avg_prompts, {mean("minutes_to_first_accepted_change")} AS avg_minutes_to_first_change, {n("debug_loop_flag = 1")} AS loop_n,
        {n("debug_loop_flag IS NOT NULL")} AS loop_d, {n("mid_session_error_paste_flag = 1")} AS error_n, {n("mid_session_error_paste_flag IS NOT NULL")} AS error_d, {n(f"{committed} = 1")} AS commit_n,
        {n(f"{committed} IS NOT NULL")} AS commit_d, {n("user_turn_count IS NOT NULL AND accepted_output_flag = 0")} AS no_output_n, {n("user_turn_count IS NOT NULL")} AS no_output_d
        FROM ({base}) base WHERE {where} {by}"""


REPORTABLE = "regexp_matches(group_value, '^[A-Z]+-[0-9]+$') AND coalesce(branch_name, '') NOT IN ('main', 'master', 'staging', 'develop', '(unknown)')"


def six(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("avg_prompts", "avg_minutes_to_first_change")})


def session_query(name: str, sql: str, **args) -> None:
    query(name, sql, COMMIT_EVENTS)(lambda read: six(reports.session_report(event_tables(read), reports.ReportArgs(**args))))


session_query("r1_session_overall", session_sql(V1, False, None, False))
session_query("r1_session_by_provider", session_sql(V1, False, "provider", False) + " ORDER BY group_value LIMIT 50", group_by="provider")
session_query("r1_session_weekly_by_provider", session_sql(V1, True, "provider", False) + " ORDER BY 1, 2 LIMIT 50", group_by="provider", weekly=True)
session_query("r1_session_by_repo_from_to", session_sql(V1, False, "repo_root", False, where="CAST(started_at AS DATE) >= DATE '2024-01-05' AND CAST(started_at AS DATE) <= DATE '2024-01-20'") + " ORDER BY 2 LIMIT 2", group_by="repo", date_from="2024-01-05", date_to="2024-01-20", limit=2)
session_query("r1_session_by_task", f"SELECT * FROM ({session_sql(V2, False, 'task_key', True, True)}) WHERE {REPORTABLE} ORDER BY group_value, branch_name LIMIT 12", group_by="task", limit=12)
session_query("r1_session_by_branch", session_sql(V3, False, "branch_name", True, where="provider = 'claude'") + " ORDER BY 2 LIMIT 50", group_by="branch", provider="claude")
session_query("r1_session_implicit_model", f"""WITH r AS ({session_sql(V1, False, "model_name", False)}), k AS (SELECT *, session_count >= 3 AS keep, max(session_count >= 3) OVER () AS has_some FROM r)
    SELECT * EXCLUDE (keep, has_some) FROM k WHERE keep OR NOT has_some ORDER BY session_count DESC, CASE WHEN no_output_d > 0 THEN no_output_n / no_output_d ELSE -1 END DESC, group_value LIMIT 6""", group_by="model", implicit_model=True, limit=6)


def delivery_sql(base: str, week_: bool, value: str | None, by_session: bool, branch: bool = False) -> str:
    cols, by = group_sql(week_, value, branch)
    shas = lambda test: f"count(DISTINCT CASE WHEN {test} THEN base.commit_sha END)"
    n = shas if by_session else (lambda test: f"count(CASE WHEN {test} THEN 1 END)")
    hosted = "base.heavy_ai_flag = 1 AND eo.repo_key LIKE 'git:github.com/%'"
    cols = cols.replace("repo_root AS", "base.repo_root AS")
    return f"""SELECT {cols}, {"count(DISTINCT base.commit_sha)" if by_session else "count(*)"} AS commit_count, {n("base.heavy_ai_flag = 1")} AS heavy_commit_count,
        {n("base.heavy_ai_flag = 1 AND base.merged_to_mainline_flag = 1")} AS mainline_n, {n("base.heavy_ai_flag = 1")} AS mainline_d, {shas(hosted)} AS pr_eligible,
        {shas(hosted + " AND lu.status IN ('resolved', 'no_pr')")} AS pr_ready, {shas(hosted + " AND pr.pr_opened_flag = 1")} AS pr_reach_n, {shas(hosted + " AND pr.pr_opened_flag = 1 AND pr.pr_merged_flag = 1")} AS pr_merge_n,
        CAST(coalesce(sum(fc.total_added), 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(fc.total_removed), 0) AS BIGINT) AS lines_removed
        FROM ({base}) base LEFT JOIN ev_outcome eo ON eo.repo_root = base.repo_root AND eo.commit_sha = base.commit_sha LEFT JOIN pr_lookups lu ON lu.repo_key = eo.repo_key AND lu.commit_sha = base.commit_sha
        LEFT JOIN ev_pr_outcome pr ON pr.repo_root = base.repo_root AND pr.commit_sha = base.commit_sha LEFT JOIN ev_commit fc ON fc.repo_root = base.repo_root AND fc.commit_sha = base.commit_sha
        {by.replace("repo_root", "base.repo_root")}"""


def delivery_query(name: str, sql: str, **args) -> None:
    query(name, sql, COMMIT_EVENTS)(lambda read: reports.delivery_report(event_tables(read), reports.ReportArgs(**args)))


delivery_query("r2_delivery_overall", delivery_sql(V4, False, None, False))
delivery_query("r2_delivery_by_repo", delivery_sql(V4, False, "repo_root", False) + " ORDER BY 2 LIMIT 50", group_by="repo")
delivery_query("r2_delivery_weekly_by_model", delivery_sql(V5, True, "model_name", True) + " ORDER BY 1, 2 LIMIT 50", group_by="model", weekly=True)
delivery_query("r2_delivery_by_task", f"SELECT * FROM ({delivery_sql(V6, False, 'task_key', False, True)}) WHERE {REPORTABLE} ORDER BY group_value, branch_name LIMIT 50", group_by="task")
delivery_query("r2_delivery_by_branch_of_claude", delivery_sql(f"SELECT * FROM ({V7}) x WHERE EXISTS (SELECT 1 FROM ev_commit_session f WHERE f.repo_root = x.repo_root AND f.commit_sha = x.commit_sha AND f.provider = 'claude')", False, "branch_name", False) + " ORDER BY 2 LIMIT 50", group_by="branch", provider="claude")

delivery_query("r2_delivery_implicit_model", f"""WITH r AS ({delivery_sql(V5, False, "model_name", True)}), k AS (SELECT *, heavy_commit_count >= 3 AND group_value <> 'human/(unknown)' AS keep FROM r), s AS (SELECT *, max(keep) OVER () AS has_some FROM k)
    SELECT * EXCLUDE (keep, has_some) FROM s WHERE keep OR NOT has_some ORDER BY heavy_commit_count DESC, CASE WHEN mainline_d > 0 THEN mainline_n / mainline_d ELSE -1 END, group_value LIMIT 4""", group_by="model", implicit_model=True, limit=4)


class NoTasks(EventTables):
    """Event tables of branches that name no task."""

    def __getattr__(self, name: str) -> DataFrame:
        table = super().__getattr__(name)
        return table.filter("task_key IN ('main', '(unknown)')") if name.startswith("task_") else table


query("r8_hint_of_branches", f"SELECT 'no branch names a task; group by branch instead' AS hint WHERE (SELECT count(*) FROM ({V3}) b WHERE branch_name IN ('main', '(unknown)')) > 0", COMMIT_EVENTS)(lambda read: reports.hidden_branches(NoTasks(read), reports.ReportArgs(group_by="task")))
query("r8_no_hint", f"SELECT 'x' AS hint WHERE (SELECT count(*) FROM ({V2}) t WHERE {REPORTABLE.replace('group_value', 'task_key')}) = 0", COMMIT_EVENTS)(lambda read: reports.hidden_branches(event_tables(read), reports.ReportArgs(group_by="task")))


def quality_sql(base: str, week_: bool, value: str | None, by_session: bool, branch: bool = False) -> str:
    cols, by = group_sql(week_, value, branch)
    share = "share_of_ai" if by_session else "1"
    n = (lambda test, v: f"CAST(round(sum(CASE WHEN {test} THEN {v} ELSE 0 END), 0) AS BIGINT)") if by_session else (lambda test, v: f"CAST(coalesce(sum(CASE WHEN {test} THEN {v} ELSE 0 END), 0) AS BIGINT)")
    heavy, merged = "heavy_ai_flag = 1", "heavy_ai_flag = 1 AND merged_to_mainline_flag = 1"
    return f"""SELECT {cols}, {"count(DISTINCT CASE WHEN heavy_ai_flag = 1 THEN commit_sha END)" if by_session else "count(CASE WHEN heavy_ai_flag = 1 THEN 1 END)"} AS heavy_commit_count,
        {n(heavy, f"{share} * ai_added_lines_removed_within_window")} AS churn_n, {n(heavy, f"{share} * ai_added_lines_reaching_mainline")} AS churn_d, {n(merged + " AND bug_after_merge_flag = 1", share)} AS bug_n,
        {n(merged, share)} AS bug_d, {n(heavy + " AND reverted_later_flag = 1", share)} AS revert_n, {n(heavy, share)} AS revert_d FROM ({base}) base {by}"""


def quality_query(name: str, sql: str, **args) -> None:
    query(name, sql, COMMIT_EVENTS)(lambda read: reports.quality_report(event_tables(read), reports.ReportArgs(**args)))


quality_query("r3_quality_overall", quality_sql(V4, False, None, False))
quality_query("r3_quality_by_repo", quality_sql(V4, False, "repo_root", False) + " ORDER BY 2 LIMIT 50", group_by="repo")
quality_query("r3_quality_by_provider", quality_sql(V5, False, "provider", True) + " ORDER BY 2 LIMIT 50", group_by="provider")
quality_query("r3_quality_weekly_by_branch", quality_sql(V7, True, "branch_name", False) + " ORDER BY 1, 2 LIMIT 50", group_by="branch", weekly=True)
quality_query("r3_quality_implicit_model", f"""WITH r AS ({quality_sql(V5, False, "model_name", True)}), k AS (SELECT *, heavy_commit_count >= 3 AND group_value <> 'human/(unknown)' AS keep FROM r), s AS (SELECT *, max(keep) OVER () AS has_some FROM k)
    SELECT * EXCLUDE (keep, has_some) FROM s WHERE keep OR NOT has_some ORDER BY heavy_commit_count DESC, CASE WHEN bug_d > 0 THEN bug_n / bug_d ELSE -1 END DESC, group_value LIMIT 50""", group_by="model", implicit_model=True)

query("r4_session_list", f"SELECT * FROM ({V8}) ORDER BY last_active DESC NULLS LAST, provider, session_id LIMIT 50", COMMIT_EVENTS)(lambda read: reports.session_list(event_tables(read), reports.ReportArgs()))
query("r4_session_list_of_task", f"SELECT * FROM ({V8}) p WHERE EXISTS (SELECT 1 FROM ev_task_session t WHERE t.provider = p.provider AND t.session_id = p.session_id AND t.task_key = 'AB-1') ORDER BY last_active DESC NULLS LAST, provider, session_id LIMIT 20", COMMIT_EVENTS)(
    lambda read: reports.session_list(event_tables(read), reports.ReportArgs(task="AB-1", limit=20))
)


def stream_sql(view_sql: str, name: str, time: str, task: bool, provider: bool) -> str:
    return f"""SELECT '{name}' AS stream_type, '{"session" if "session-base" in name and "commit" not in name else "delivery"}' AS category, strftime({time}, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time, repo_root,
        {"provider" if provider else NULLS} AS provider, {"model_name" if provider else NULLS} AS model, {"task_key" if task else NULLS} AS task_key, {"branch_name" if task else NULLS} AS branch_name FROM ({view_sql})"""


STREAM = " UNION ALL ".join([stream_sql(V1, "session-base", "started_at", False, True), stream_sql(V2, "task-session-base", "started_at", True, True), stream_sql(V4, "change-base", "commit_time", False, False),
                             stream_sql(V5, "commit-session-base", "commit_time", False, True), stream_sql(V6, "task-commit-base", "commit_time", True, False)])
query("r5_event_stream", STREAM, COMMIT_EVENTS)(lambda read: stream.event_stream(event_tables(read)).drop("fields"))
#: The columns of each base as the stream's `fields` have them, by name.
SESSION_FIELDS = "accepted_output_flag debug_loop_flag first_accepted_change_at mid_session_error_paste_flag minutes_to_first_accepted_change model_name provider repo_root session_commit_within_4h_flag session_id started_at user_turn_count week_start".split()
CHANGE_FIELDS = "ai_added_lines_reaching_mainline ai_added_lines_removed_within_window bug_after_merge_flag bug_signal_count commit_sha commit_time commit_total_changed_lines first_bug_signal_commit_sha first_bug_signal_commit_time heavy_ai_flag merged_to_mainline_flag repo_root reverted_later_flag week_start".split()
TIMES = ("first_accepted_change_at", "started_at", "commit_time", "first_bug_signal_commit_time")


def fields_sql(view_sql: str, keys: list[str]) -> str:
    text = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')" if c in TIMES else f"CAST(round({c}, 6) AS VARCHAR)" if c.startswith("minutes") else f"CAST({c} AS VARCHAR)"
    return f"SELECT {', '.join(f'{text(c)} AS f_{c}' for c in keys)}, {len(keys)} AS n_fields FROM ({view_sql})"


def field_by_field(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of `fields` as a column, and how many keys there are."""
    value = lambda c: F.round(F.get_json_object("fields", f"$.{c}").cast("double"), 6).cast("string") if c.startswith("minutes") else F.get_json_object("fields", f"$.{c}")
    return rows.select(*[value(c).alias(f"f_{c}") for c in keys], F.size(F.json_object_keys("fields")).alias("n_fields"))


query("r5_session_fields", fields_sql(V1, SESSION_FIELDS), COMMIT_EVENTS)(lambda read: field_by_field(stream.event_stream(event_tables(read), "session-base"), SESSION_FIELDS))
query("r5_change_fields", fields_sql(V4, CHANGE_FIELDS), COMMIT_EVENTS)(lambda read: field_by_field(stream.event_stream(event_tables(read), "change-base"), CHANGE_FIELDS))
for category, views_ in (("session", [("session-base", V1, "started_at", False, True), ("task-session-base", V2, "started_at", True, True)]), ("quality", [("change-base", V4, "commit_time", False, False), ("commit-session-base", V5, "commit_time", False, True), ("task-commit-base", V6, "commit_time", True, False)])):
    query(f"r5_event_stream_of_{category}", f"SELECT * REPLACE ('{category}' AS category) FROM (" + " UNION ALL ".join(stream_sql(sql, *more[:2], *more[2:]) for name, sql, *rest in views_ for more in [[name, *rest]]) + ")", COMMIT_EVENTS)(lambda read, c=category: stream.event_stream(event_tables(read), category=c).drop("fields"))
query("f2_stream_of_a_task", f"SELECT * FROM ({STREAM}) WHERE task_key = 'AB-1'", COMMIT_EVENTS)(lambda read: stream.event_stream(event_tables(read), args=reports.ReportArgs(task="AB-1")).drop("fields"))
query("r5_event_stream_ndjson")(lambda read: stream.ndjson(stream.event_stream(event_tables(read), "session-base")))

# ---- conversations

LOWER_HAS = lambda t, parts: "(" + " OR ".join(f"contains({t}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"
MARKED = "lower(content)"
PASTE = f"({LOWER_HAS(MARKED, C.ERROR_MARKERS + C.LOOSE_MARKERS)} OR (contains({MARKED}, ' failed') AND {LOWER_HAS(MARKED, C.FAILED_SUBJECTS)}) OR regexp_matches({MARKED}, '{C.NUMBERED_ERRORS}'))"
TURNS = """WITH placed AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY provider, session_id ORDER BY message_index) AS turn FROM messages WHERE role IN ('user', 'assistant')),
    turns AS (SELECT provider, session_id, CAST(turn AS BIGINT) AS turn, max(CASE WHEN role = 'user' THEN content END) AS user_text, coalesce(string_agg(content, chr(10) ORDER BY message_index) FILTER (role = 'assistant'), '') AS assistant_text
              FROM placed WHERE turn > 0 GROUP BY provider, session_id, turn)"""
# every message of the relation is one line, and its tokens need no trimming but of case and digits
SIGNED = f"""{TURNS}, told AS (SELECT *, {LOWER_HAS("lower(user_text)", C.CONTINUATIONS)} AS cont, {LOWER_HAS("' ' || lower(user_text) || ' '", C.DEBUG_KEYWORDS)} AS debug FROM turns WHERE regexp_matches(user_text, '\\S') AND regexp_matches(assistant_text, '\\S')),
    runs AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY provider, session_id ORDER BY turn) AS run, CASE WHEN debug THEN regexp_replace(lower(user_text), '[0-9]+', '#', 'g') END AS own FROM told),
    signed AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY provider, session_id, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signature FROM runs),
    loops AS (SELECT provider, session_id, max(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS debug_loop_flag FROM (SELECT provider, session_id, signature, count(*) AS n FROM signed WHERE signature IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""
PASTES = f"SELECT provider, session_id, max(CASE WHEN message_index > f AND {PASTE} THEN 1 ELSE 0 END) AS mid_session_error_paste_flag FROM (SELECT *, min(message_index) OVER (PARTITION BY provider, session_id) AS f FROM messages WHERE role = 'user') GROUP BY ALL"
WORDS = "SELECT provider, session_id, CAST(sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS user_word_count FROM messages WHERE role = 'user' GROUP BY ALL"

query("w1_turns", f"{TURNS} SELECT * FROM turns", ("messages",))(lambda read: conversation.turns(read("messages")))
query("w2_turn_counts", f"{TURNS} SELECT provider, session_id, count(*) AS user_turn_count FROM turns WHERE regexp_matches(user_text, '\\S') GROUP BY ALL", ("messages",))(lambda read: conversation.user_turn_counts(conversation.turns(read("messages"))))
query("w3_error_pastes", PASTES, ("messages",))(lambda read: conversation.error_pastes(read("messages")))
query("w4_debug_loops", f"{SIGNED} SELECT * FROM loops", ("messages",))(lambda read: conversation.debug_loops(conversation.turns(read("messages"))))
query("a7_user_words", WORDS, ("messages",))(lambda read: conversation.user_words(read("messages")))

# ---- scalar expressions

query("x9_task_keys", """SELECT branch, CASE WHEN p <> '' THEN upper(p) || '-' || n ELSE branch END AS task_key FROM (SELECT branch, regexp_extract(branch, '(^|[^A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)', 2) AS p,
    regexp_extract(branch, '(^|[^A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)', 3) AS n FROM (SELECT DISTINCT branch FROM branch_commits))""", ("branch_commits",))(lambda read: read("branch_commits").select("branch").distinct().select("branch", C.task_key(F.col("branch")).alias("task_key")))
query("x13_messages", r"""SELECT commit_sha, regexp_matches(message, '(?i)\b(fix|fixes|fixed|bug|bugs|hotfix|hotfixes|patch|patches|broken|regression|regressions)\b') AS fix_like,
    starts_with(ltrim(message, ' '), 'Revert ') OR starts_with(ltrim(message, ' '), 'revert ') OR contains(message, 'This reverts commit ') AS is_revert,
    len(regexp_extract_all(message, '(?m)This reverts commit [0-9a-fA-F]{40}([^0-9a-fA-F]|$)')) AS n_reverted FROM commits""", ("commits",))(
    lambda read: read("commits").select("commit_sha", C.is_fix_like(F.col("message")).alias("fix_like"), C.is_revert(F.col("message")).alias("is_revert"), F.size(C.reverted_shas(F.col("message"))).alias("n_reverted"))
)
query("x1_models_by_week", f"""SELECT {nm("provider", "model_name")} AS model_name, {week("started_at")} AS week_start, count(*) AS n FROM sessions GROUP BY ALL""", ("sessions",))(
    lambda read: as_text(read("sessions").groupBy(C.normalized_model(F.col("provider"), F.col("model_name")).alias("model_name"), C.week_start(F.col("started_at")).alias("week_start")).agg(F.count("*").alias("n")))
)
query("x10_natural_order", """SELECT task_key, row_number() OVER (ORDER BY NOT regexp_matches(task_key, '^[A-Za-z]+[-_][0-9]'), CASE WHEN regexp_matches(task_key, '^[A-Za-z]+[-_][0-9]') THEN upper(regexp_extract(task_key, '^([A-Za-z]+)[-_]', 1)) ELSE '' END,
    coalesce(TRY_CAST(regexp_extract(task_key, '^[A-Za-z]+[-_]([0-9]+)', 1) AS BIGINT), 0), task_key) AS place FROM (SELECT DISTINCT task_key FROM ev_task_commit)""", ("ev_task_commit",))(
    lambda read: natural_places(read("ev_task_commit").select("task_key").distinct())
)


def natural_places(keys: DataFrame) -> DataFrame:
    """The place of each key: in its range of keys, after all of the ranges before it."""
    order = C.natural_task_key(F.col("task_key"))
    ranged = written(keys.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumnRenamed("_range", "_other").join(ranged.select("_range").distinct(), F.col("_other") < F.col("_range"), "right").groupBy("_range").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_place", within).join(before, "_range").select("task_key", (F.col("_before") + F.col("_place")).cast("int").alias("place"))


# ---- line hashes over whole documents

HASHED = r"""SELECT doc_id, '+' AS side, md5(regexp_replace(line, '[ \t\r]+$', '')) AS line_hash, count(*) AS count FROM (SELECT doc_id, unnest(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS line FROM documents) GROUP BY ALL"""
query("h2_text_hashes", HASHED)(lambda read: hashing.text_hashes(read("documents"), ["doc_id"], "text", "+"))
query("h5_overlap_of_neighbours", f"""WITH h AS ({HASHED}) SELECT a.doc_id, CAST(sum(least(a.count, b.count)) AS BIGINT) AS overlap FROM h a JOIN h b ON b.doc_id = a.doc_id + 1 AND a.line_hash = b.line_hash GROUP BY ALL""")(
    lambda read: (lambda h: hashing.overlap(h, h.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id", "side", "line_hash"], ["doc_id"]))(hashing.text_hashes(read("documents"), ["doc_id"], "text", "+"))
)

# ---- attribution

LINES = ("commit_hashes", "change_hashes")
AVAIL = "avail AS (SELECT repo_root, rel_path, side, line_hash, provider, session_id, max(count) AS avail FROM change_hashes GROUP BY ALL)"
ATTRIBUTED = f"""{AVAIL}, rows_ AS (SELECT repo_root, commit_sha, rel_path, side, line_hash, sum(count) AS count FROM commit_hashes GROUP BY ALL), have AS (SELECT repo_root, rel_path, side, line_hash, sum(avail) AS total FROM avail GROUP BY ALL),
    files AS (SELECT repo_root, commit_sha, rel_path, sum(count) AS total_lines FROM rows_ GROUP BY ALL),
    strict AS (SELECT r.*, h.total, h.rel_path AS used, least(r.count, h.total) AS matched FROM rows_ r JOIN have h USING (repo_root, rel_path, side, line_hash)),
    weak AS (SELECT f.*, coalesce(s.m, 0) AS strict_lines FROM files f LEFT JOIN (SELECT repo_root, commit_sha, rel_path, sum(matched) AS m FROM strict GROUP BY ALL) s USING (repo_root, commit_sha, rel_path) WHERE coalesce(s.m, 0) / f.total_lines < 0.2),
    one AS (SELECT repo_root, rel_path AS candidate, side, line_hash, max(count) AS have FROM change_hashes GROUP BY ALL),
    scored AS (SELECT w.repo_root, w.commit_sha, w.rel_path, w.total_lines, o.candidate, sum(least(r.count, o.have)) AS score, regexp_extract(o.candidate, '[^/]*$') = regexp_extract(w.rel_path, '[^/]*$') AS same
        FROM weak w JOIN rows_ r USING (repo_root, commit_sha, rel_path) JOIN one o ON o.repo_root = r.repo_root AND o.side = r.side AND o.line_hash = r.line_hash AND o.candidate <> w.rel_path GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_root, commit_sha, rel_path ORDER BY score DESC, candidate) AS ra, lead(score) OVER (PARTITION BY repo_root, commit_sha, rel_path ORDER BY score DESC, candidate) AS na,
        row_number() OVER (PARTITION BY repo_root, commit_sha, rel_path, same ORDER BY score DESC, candidate) AS rs, lead(score) OVER (PARTITION BY repo_root, commit_sha, rel_path, same ORDER BY score DESC, candidate) AS ns FROM scored),
    picked AS (SELECT repo_root, commit_sha, rel_path, coalesce(max(candidate) FILTER (same AND rs = 1 AND score / total_lines >= 0.8 AND score >= 30 AND score / total_lines - coalesce(ns, 0) / total_lines >= 0.2),
        max(candidate) FILTER (ra = 1 AND score / total_lines >= 0.8 AND score >= 30 AND score / total_lines - coalesce(na, 0) / total_lines >= 0.2)) AS alias FROM ranked GROUP BY ALL),
    moved AS (SELECT r.*, h.total, h.rel_path AS used, least(r.count, h.total) AS matched FROM rows_ r JOIN picked p USING (repo_root, commit_sha, rel_path) JOIN have h ON h.repo_root = r.repo_root AND h.rel_path = p.alias AND h.side = r.side AND h.line_hash = r.line_hash),
    better AS (SELECT repo_root, commit_sha, rel_path FROM (SELECT repo_root, commit_sha, rel_path, sum(matched) AS m FROM moved GROUP BY ALL) JOIN weak USING (repo_root, commit_sha, rel_path) WHERE m > strict_lines),
    chosen AS (SELECT * FROM strict ANTI JOIN better USING (repo_root, commit_sha, rel_path) UNION ALL SELECT * FROM moved SEMI JOIN better USING (repo_root, commit_sha, rel_path)),
    sums AS (SELECT repo_root, commit_sha, CAST(coalesce(sum(matched) FILTER (side = '+'), 0) AS BIGINT) AS matched_added_lines, CAST(coalesce(sum(matched) FILTER (side = '-'), 0) AS BIGINT) AS matched_removed_lines FROM chosen GROUP BY ALL),
    facts AS (SELECT repo_root, commit_sha, CAST(coalesce(sum(count) FILTER (side = '+'), 0) AS BIGINT) AS total_added, CAST(coalesce(sum(count) FILTER (side = '-'), 0) AS BIGINT) AS total_removed, coalesce(any_value(s.matched_added_lines), 0) AS matched_added_lines,
        coalesce(any_value(s.matched_removed_lines), 0) AS matched_removed_lines FROM rows_ LEFT JOIN sums s USING (repo_root, commit_sha) GROUP BY repo_root, commit_sha)"""
query("a13_session_availability", f"WITH {AVAIL} SELECT * FROM avail", ("change_hashes",))(lambda read: attribution.session_availability(read("change_hashes")))
query("a15_provider_availability", "SELECT repo_root, rel_path, line_hash, CAST(sum(m) AS BIGINT) AS avail FROM (SELECT repo_root, rel_path, line_hash, provider, max(count) AS m FROM change_hashes WHERE side = '+' GROUP BY ALL) GROUP BY ALL", ("change_hashes",))(
    lambda read: attribution.provider_availability(read("change_hashes"))
)
query("a17_commit_attribution", f"""WITH {ATTRIBUTED} SELECT *, matched_added_lines + matched_removed_lines AS matched_total_lines, round((matched_added_lines + matched_removed_lines) / (total_added + total_removed), 6) AS ai_share,
    CASE WHEN (matched_added_lines + matched_removed_lines) / (total_added + total_removed) >= 0.5 THEN 1 ELSE 0 END AS heavy_ai FROM facts""", LINES)(
    lambda read: attribution.commit_facts(attribution.Matched(read("commit_hashes"), read("change_hashes"))).withColumn("ai_share", F.round("ai_share", 6))
)
SHARES = f"""{ATTRIBUTED}, parts AS (SELECT c.repo_root, c.commit_sha, a.provider, a.session_id, sum(c.matched * a.avail / c.total) AS matched_lines FROM chosen c JOIN avail a ON a.repo_root = c.repo_root AND a.rel_path = c.used AND a.side = c.side AND a.line_hash = c.line_hash GROUP BY ALL),
    shares AS (SELECT p.*, p.matched_lines / (total_added + total_removed) AS share_of_commit, p.matched_lines / (matched_added_lines + matched_removed_lines) AS share_of_ai FROM parts p JOIN facts USING (repo_root, commit_sha)
        UNION ALL SELECT repo_root, commit_sha, 'human', '__human__', 0, 1, 0 FROM facts WHERE matched_added_lines + matched_removed_lines = 0)"""
query("a16_session_shares", f"WITH {SHARES} SELECT repo_root, commit_sha, provider, session_id, round(matched_lines, 5) AS matched_lines, round(share_of_commit, 5) AS share_of_commit, round(share_of_ai, 5) AS share_of_ai FROM shares", LINES)(
    lambda read: attribution.attributed(read("commit_hashes"), read("change_hashes"))[1].withColumns({c: F.round(c, 5) for c in ("matched_lines", "share_of_commit", "share_of_ai")})
)

# ---- outcomes

BUDGET = """added_ AS (SELECT repo_root, commit_sha, rel_path, line_hash, sum(count) AS n FROM commit_hashes WHERE side = '+' GROUP BY ALL),
    most AS (SELECT repo_root, rel_path, line_hash, sum(m) AS avail FROM (SELECT repo_root, rel_path, line_hash, provider, max(count) AS m FROM change_hashes WHERE side = '+' GROUP BY ALL) GROUP BY ALL),
    budget AS (SELECT a.repo_root, a.commit_sha, a.rel_path, a.line_hash, least(n, avail) AS budget, c.commit_time FROM added_ a JOIN most USING (repo_root, rel_path, line_hash) JOIN commits c ON c.repo_root = a.repo_root AND c.commit_sha = a.commit_sha)"""
FACT_LINES = ("commit_hashes", "change_hashes", "commits")


def timed_budget(read: Read, lines: DataFrame | None = None) -> DataFrame:
    """With `lines`, only of lines that these have."""
    tables = [read("commit_hashes"), read("change_hashes")]
    return attribution.ai_budget(*(tables if lines is None else attribution.on_lines(lines, *tables))).join(read("commits").select("repo_root", "commit_sha", "commit_time"), attribution.BY_COMMIT)


def mainline_events(read: Read, side: str) -> DataFrame:
    return read("commit_hashes").filter((F.col("on_mainline") == 1) & (F.col("side") == side)).withColumn("event_time", F.col("commit_time"))


query("h6_ai_budget", f"WITH {BUDGET} SELECT repo_root, commit_sha, rel_path, line_hash, CAST(budget AS BIGINT) AS budget FROM budget", FACT_LINES)(lambda read: attribution.ai_budget(read("commit_hashes"), read("change_hashes")))
LATER = f"""{BUDGET}, own AS (SELECT b.repo_root, b.commit_sha, b.rel_path, b.line_hash, b.budget, b.commit_time, coalesce(max(CASE WHEN e.commit_time >= b.commit_time THEN e.count END), 0) AS found FROM budget b
    LEFT JOIN (SELECT * FROM commit_hashes WHERE side = '+' AND on_mainline = 1) e ON e.repo_root = b.repo_root AND e.rel_path = b.rel_path AND e.line_hash = b.line_hash GROUP BY ALL)"""
query("j10_added_later", f"WITH {LATER} SELECT repo_root, commit_sha, rel_path, CAST(sum(budget) AS BIGINT) AS total_lines, CAST(sum(least(budget, found)) AS BIGINT) AS strict FROM own GROUP BY ALL", FACT_LINES)(
    lambda read: outcomes.added_later(timed_budget(read), mainline_events(read, "+")).groupBy("repo_root", "commit_sha", "rel_path").agg(F.sum("budget").alias("total_lines"), F.sum(F.least("budget", "found")).alias("strict"))
)
query("j11_churn", f"""WITH {BUDGET} SELECT repo_root, commit_sha, CAST(sum(least(budget, gone)) AS BIGINT) AS ai_added_lines_removed_within_window FROM (SELECT b.repo_root, b.commit_sha, b.rel_path, b.line_hash, b.budget, sum(e.count) AS gone FROM budget b
    JOIN commits c ON c.repo_root = b.repo_root AND c.commit_sha = b.commit_sha AND c.on_mainline = 1
    JOIN commit_hashes e ON e.side = '-' AND e.on_mainline = 1 AND e.repo_root = b.repo_root AND e.rel_path = b.rel_path AND e.line_hash = b.line_hash AND e.commit_time BETWEEN b.commit_time AND b.commit_time + INTERVAL 14 DAY GROUP BY ALL) GROUP BY ALL""", FACT_LINES)(
    lambda read: (lambda removed: outcomes.churn(timed_budget(read, removed), removed, read("commits").filter("on_mainline = 1")))(mainline_events(read, "-"))
)
query("j12_bug_signals", f"""WITH {BUDGET}, fixes AS (SELECT h.repo_root, h.commit_sha AS ref, h.commit_time AS fixed, h.rel_path, h.line_hash, sum(h.count) AS n FROM commit_hashes h JOIN commits c ON c.repo_root = h.repo_root AND c.commit_sha = h.commit_sha WHERE side = '-' AND c.message = 'fix parser' GROUP BY ALL),
    found AS (SELECT b.repo_root, b.commit_sha, f.ref, f.fixed, sum(least(b.budget, f.n)) AS overlap FROM budget b JOIN fixes f USING (repo_root, rel_path, line_hash) WHERE f.fixed > b.commit_time AND f.fixed <= b.commit_time + INTERVAL 60 DAY GROUP BY ALL)
    SELECT repo_root, commit_sha, 1 AS bug_after_merge_flag, first(ref ORDER BY fixed, ref) AS first_bug_signal_commit_sha, min(fixed) AS first_bug_signal_commit_time, count(*) AS bug_signal_count, 60 AS window_days, 'git_fix_commit' AS signal_source FROM found WHERE overlap > 0 GROUP BY ALL""", FACT_LINES)(
    lambda read: (lambda fixes: outcomes.bugs_after(timed_budget(read, fixes), fixes))(outcomes.fix_signals(read("commits"), read("commit_hashes")))
)
query("m4_pr_outcomes", """SELECT o.repo_root, o.commit_sha, l.status AS lookup_status, l.owning_pr_number AS pr_number, CASE WHEN l.status = 'resolved' THEN 1 ELSE 0 END AS pr_opened_flag,
    CASE WHEN l.status = 'resolved' AND p.merged = 1 THEN 1 ELSE 0 END AS pr_merged_flag FROM ev_outcome o JOIN pr_lookups l ON l.repo_key = o.repo_key AND l.commit_sha = o.commit_sha
    LEFT JOIN pulls p ON p.repo_key = l.repo_key AND p.pr_number = l.owning_pr_number WHERE o.heavy_ai_flag = 1 AND o.repo_key LIKE 'git:github.com/%' AND l.status IN ('resolved', 'no_pr')""", ("ev_outcome", "pulls"))(
    lambda read: outcomes.pr_outcomes(read("ev_outcome"), read("pr_lookups"), read("pulls"))
)

# ---- branches

ASSIGNED = """WITH spine AS (SELECT * FROM branch_commits WHERE on_first_parent = 1), own AS (SELECT * FROM spine s WHERE branch NOT IN ('main', 'master', 'staging', 'develop')
        AND NOT EXISTS (SELECT 1 FROM spine i WHERE i.branch IN ('main', 'master', 'staging', 'develop') AND i.repo_root = s.repo_root AND i.commit_sha = s.commit_sha)),
    r AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w - distance AS margin, count(*) OVER (PARTITION BY repo_root, commit_sha) AS candidate_count FROM own WINDOW w AS (PARTITION BY repo_root, commit_sha ORDER BY distance, branch)),
    p AS (SELECT repo_root, commit_sha, branch AS branch_name, 'task_branch' AS source, 0 AS is_fallback, candidate_count, distance AS distance_to_tip, CASE WHEN margin IS NULL THEN 1.0 WHEN margin >= 2 THEN 0.9 WHEN margin = 1 THEN 0.75 ELSE 0.6 END AS confidence FROM r WHERE n = 1),
    f AS (SELECT repo_root, commit_sha, arg_min(branch, list_position(['staging', 'main', 'master', 'develop'], branch)) AS b, arg_min(distance, list_position(['staging', 'main', 'master', 'develop'], branch)) AS d FROM branch_commits WHERE branch IN ('staging', 'main', 'master', 'develop') GROUP BY ALL),
    u AS (SELECT * FROM p UNION ALL SELECT c.repo_root, c.commit_sha, coalesce(f.b, '(unknown)'), 'integration_fallback', 1, 0, f.d, CASE WHEN f.b IS NULL THEN 0.0 ELSE 0.5 END FROM (SELECT DISTINCT repo_root, commit_sha FROM commits) c
        LEFT JOIN f USING (repo_root, commit_sha) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo_root = c.repo_root AND p.commit_sha = c.commit_sha))
    SELECT repo_root, commit_sha, branch_name, source, is_fallback, candidate_count, distance_to_tip, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN regexp_extract(branch_name, '(^|[^A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)', 2) <> ''
        THEN upper(regexp_extract(branch_name, '(^|[^A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)', 2)) || '-' || regexp_extract(branch_name, '(^|[^A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)', 3) ELSE branch_name END AS task_key FROM u"""
query("w8_branch_assignment", ASSIGNED, ("branch_commits", "commits"))(lambda read: branches.assigned(read("commits"), read("branch_commits")))

# ---- materialization

MATCHES = f"""{SHARES}, matches AS (SELECT s.provider, s.session_id, c.commit_time FROM shares s JOIN commits c ON c.repo_root = s.repo_root AND c.commit_sha = s.commit_sha)"""


SESSION_ROWS = f"""signals_ AS (SELECT provider, session_id, min(ts) AS lo, max(ts) AS hi FROM (SELECT provider, session_id, message_ts AS ts FROM messages UNION ALL SELECT provider, session_id, change_ts FROM changes WHERE source_kind = 'accepted_change') WHERE ts IS NOT NULL GROUP BY ALL),
    lines_ AS (SELECT provider, session_id, sum(lines_added) AS a, sum(lines_removed) AS r FROM changes WHERE source_kind = 'accepted_change' GROUP BY ALL),
    output_ AS (SELECT provider, session_id, min(CASE WHEN lines_added > 0 OR lines_removed > 0 THEN change_ts END) AS first_at, max(CASE WHEN lines_added > 0 OR lines_removed > 0 THEN 1 ELSE 0 END) AS flag FROM changes GROUP BY ALL),
    words_ AS ({WORDS}),
    rows_s AS (SELECT s.*, g.lo, g.hi, l.a, l.r, o.first_at, o.flag, w.user_word_count AS words, coalesce(s.started_at, g.lo) AS begin_,
        CASE WHEN s.provider = 'cursor' THEN coalesce(g.hi, s.ended_at, s.started_at) ELSE coalesce(g.hi, s.started_at) END AS last_ FROM sessions s LEFT JOIN signals_ g USING (provider, session_id) LEFT JOIN lines_ l USING (provider, session_id)
        LEFT JOIN output_ o USING (provider, session_id) LEFT JOIN words_ w USING (provider, session_id) WHERE s.started_at IS NOT NULL OR w.user_word_count IS NOT NULL OR l.a IS NOT NULL OR l.r IS NOT NULL OR o.flag IS NOT NULL)"""
query("m1_session_productivity", f"""WITH {SESSION_ROWS} SELECT provider, session_id, repo_root, {nm("provider", "model_name")} AS model_name, coalesce(nullif(trim(project_path, ' '), ''), '(unknown)') AS project_path, coalesce(lo, started_at) AS started_at, last_ AS ended_at,
    CAST(coalesce(a, 0) AS BIGINT) AS accepted_lines_added, CAST(coalesce(r, 0) AS BIGINT) AS accepted_lines_removed, CAST(coalesce(a, 0) + coalesce(r, 0) AS BIGINT) AS accepted_total_changed_lines, coalesce(words, 0) AS user_word_count FROM rows_s""", ("sessions", "messages", "changes"))(
    lambda read: events.session_events(read("sessions"), read("messages"), read("changes"), lambda spans: spans.select("provider", "session_id", F.col("_end").alias("commit_time")).filter("false"))[1]
)
query("m1_session_quality", f"""{SIGNED}, {MATCHES}, {SESSION_ROWS}, counts AS (SELECT provider, session_id, count(*) AS user_turn_count FROM turns WHERE regexp_matches(user_text, '\\S') GROUP BY ALL), pastes AS ({PASTES}),
    hits AS (SELECT DISTINCT provider, session_id FROM rows_s r JOIN matches m USING (provider, session_id) WHERE m.commit_time >= r.begin_ AND m.commit_time <= coalesce(r.ended_at, r.started_at, r.last_, coalesce(r.lo, r.started_at)) + INTERVAL 4 HOUR)
    SELECT r.provider, r.session_id, repo_root, {nm("r.provider", "model_name")} AS model_name, started_at, ended_at, c.user_turn_count, coalesce(d.debug_loop_flag, 0) AS debug_loop_flag, coalesce(p.mid_session_error_paste_flag, 0) AS mid_session_error_paste_flag,
        coalesce(flag, 0) AS accepted_output_flag, first_at AS first_accepted_change_at, round((epoch_us(first_at) - epoch_us(begin_)) / 60000000.0, 8) AS minutes_to_first_accepted_change, CASE WHEN h.provider IS NULL THEN 0 ELSE 1 END AS session_commit_within_4h_flag
    FROM rows_s r JOIN counts c USING (provider, session_id) LEFT JOIN loops d USING (provider, session_id) LEFT JOIN pastes p USING (provider, session_id) LEFT JOIN hits h USING (provider, session_id)""", ("sessions", "messages", "changes", "commits", "commit_hashes", "change_hashes"))(
    lambda read: events.session_events(read("sessions"), read("messages"), read("changes"), lambda spans: attribution.matches_within(read("commit_hashes"), read("change_hashes"), read("commits"), spans))[0].withColumn("minutes_to_first_accepted_change", F.round("minutes_to_first_accepted_change", 8))
)
query("m3_task_sessions", """SELECT t.repo_root, t.task_key, s.provider, s.session_id, min(t.branch_name) AS branch_name, max(s.model_name) AS model_name, max(q.started_at) AS started_at, sum(s.matched_lines) AS attribution_weight, max(q.user_turn_count) AS user_turn_count,
    max(q.debug_loop_flag) AS debug_loop_flag, max(q.mid_session_error_paste_flag) AS mid_session_error_paste_flag, max(q.accepted_output_flag) AS accepted_output_flag, max(q.first_accepted_change_at) AS first_accepted_change_at,
    max(q.minutes_to_first_accepted_change) AS minutes_to_first_accepted_change, max(CASE WHEN s.commit_time >= q.started_at AND s.commit_time <= coalesce(q.ended_at, q.started_at) + INTERVAL 4 HOUR THEN 1 ELSE 0 END) AS commit_within_window_flag
    FROM ev_task_commit t JOIN ev_commit_session s ON s.repo_root = t.repo_root AND s.commit_sha = t.commit_sha LEFT JOIN ev_quality q ON q.provider = s.provider AND q.session_id = s.session_id GROUP BY t.repo_root, t.task_key, s.provider, s.session_id""",
      ("ev_task_commit", "ev_commit_session", "ev_quality"))(lambda read: events.task_sessions(read("ev_task_commit"), read("ev_commit_session"), read("ev_quality")))


COMMIT_KEY = "repo_root, commit_sha"
PICK = "score / total_lines >= 0.8 AND score >= 30 AND score / total_lines - coalesce({0}, 0) / total_lines >= 0.2"
OUTCOMES = f"""{SHARES}, {LATER}, m_files AS (SELECT repo_root, commit_sha, rel_path, sum(budget) AS total_lines, sum(least(budget, found)) AS strict FROM own GROUP BY ALL),
    m_rows AS (SELECT b.*, f.total_lines FROM budget b JOIN m_files f USING (repo_root, commit_sha, rel_path) WHERE f.strict / f.total_lines < 0.2),
    m_have AS (SELECT b.repo_root, b.commit_sha, b.rel_path, b.line_hash, b.budget, b.total_lines, e.rel_path AS candidate, max(e.count) AS have FROM m_rows b JOIN commit_hashes e ON e.side = '+' AND e.on_mainline = 1
        AND e.repo_root = b.repo_root AND e.line_hash = b.line_hash AND e.rel_path <> b.rel_path AND e.commit_time >= b.commit_time GROUP BY ALL),
    m_scored AS (SELECT repo_root, commit_sha, rel_path, total_lines, candidate, sum(least(budget, have)) AS score, regexp_extract(candidate, '[^/]*$') = regexp_extract(rel_path, '[^/]*$') AS same FROM m_have GROUP BY ALL),
    m_ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_root, commit_sha, rel_path ORDER BY score DESC, candidate) AS ra, lead(score) OVER (PARTITION BY repo_root, commit_sha, rel_path ORDER BY score DESC, candidate) AS na,
        row_number() OVER (PARTITION BY repo_root, commit_sha, rel_path, same ORDER BY score DESC, candidate) AS rs, lead(score) OVER (PARTITION BY repo_root, commit_sha, rel_path, same ORDER BY score DESC, candidate) AS ns FROM m_scored),
    m_picked AS (SELECT repo_root, commit_sha, rel_path, coalesce(max(candidate) FILTER (same AND rs = 1 AND {PICK.format("ns")}), max(candidate) FILTER (ra = 1 AND {PICK.format("na")})) AS candidate FROM m_ranked GROUP BY ALL),
    m_moved AS (SELECT s.repo_root, s.commit_sha, s.rel_path, s.score FROM m_scored s JOIN m_picked p USING (repo_root, commit_sha, rel_path, candidate)),
    m_content AS (SELECT repo_root, commit_sha FROM (SELECT f.repo_root, f.commit_sha, sum(f.total_lines) AS total, sum(greatest(f.strict, coalesce(m.score, 0))) AS got FROM m_files f LEFT JOIN m_moved m USING (repo_root, commit_sha, rel_path) GROUP BY ALL)
        WHERE got >= 30 AND got / total >= 0.8),
    m_reverts AS (SELECT repo_root, sha AS commit_sha, min(commit_time) AS reverted_at FROM (SELECT repo_root, commit_time, regexp_extract(message, 'This reverts commit ([0-9a-f]+)', 1) AS sha FROM commits) WHERE sha <> '' GROUP BY ALL),
    m_sums AS (SELECT repo_root, commit_sha, CAST(sum(budget) AS BIGINT) AS n FROM budget GROUP BY ALL),
    m_plain AS (SELECT * FROM commits WHERE event_id % 23 <> 0),
    m_outcome AS (SELECT p.repo_root, p.commit_sha, p.commit_time, CASE WHEN (matched_added_lines + matched_removed_lines) / (total_added + total_removed) >= 0.5 THEN 1 ELSE 0 END AS heavy_ai_flag,
        CASE WHEN p.on_mainline = 1 OR c.commit_sha IS NOT NULL THEN 1 ELSE 0 END AS merged_to_mainline_flag, CASE WHEN r.reverted_at > p.commit_time THEN 1 ELSE 0 END AS reverted_later_flag,
        total_added + total_removed AS commit_total_changed_lines, matched_added_lines + matched_removed_lines AS matched_total_lines, coalesce(b.n, 0) AS budget_total
        FROM m_plain p JOIN facts f USING ({COMMIT_KEY}) LEFT JOIN m_content c USING ({COMMIT_KEY}) LEFT JOIN m_reverts r USING ({COMMIT_KEY}) LEFT JOIN m_sums b USING ({COMMIT_KEY})),
    m_gone AS (SELECT repo_root, commit_sha, CAST(sum(least(budget, gone)) AS BIGINT) AS gone FROM (SELECT b.repo_root, b.commit_sha, b.rel_path, b.line_hash, b.budget, sum(e.count) AS gone FROM budget b
        JOIN commit_hashes e ON e.side = '-' AND e.on_mainline = 1 AND e.repo_root = b.repo_root AND e.rel_path = b.rel_path AND e.line_hash = b.line_hash AND e.commit_time BETWEEN b.commit_time AND b.commit_time + INTERVAL 14 DAY GROUP BY ALL) GROUP BY ALL),
    m_fixes AS (SELECT h.repo_root, h.commit_sha AS ref, h.commit_time AS fixed, h.rel_path, h.line_hash FROM commit_hashes h JOIN commits c ON c.repo_root = h.repo_root AND c.commit_sha = h.commit_sha WHERE side = '-' AND c.message = 'fix parser' GROUP BY ALL),
    m_found AS (SELECT DISTINCT b.repo_root, b.commit_sha, f.ref, f.fixed FROM budget b JOIN m_outcome o ON o.repo_root = b.repo_root AND o.commit_sha = b.commit_sha AND o.heavy_ai_flag = 1 AND o.merged_to_mainline_flag = 1
        JOIN m_fixes f ON f.repo_root = b.repo_root AND f.rel_path = b.rel_path AND f.line_hash = b.line_hash AND f.fixed > b.commit_time AND f.fixed <= b.commit_time + INTERVAL 60 DAY)"""
M2_LINES = ("commit_hashes", "change_hashes", "commits", "sessions")


def commit_tables(read: Read) -> dict[str, DataFrame]:
    commits = read("commits")
    return events.commit_events(commits, read("commit_hashes").select("repo_root", "commit_sha", "rel_path", "side", "line_hash", "count"), read("change_hashes"), read("sessions"), commits.filter("on_mainline = 1"), commits.filter("event_id % 23 = 0"))


query("m2_commit_outcomes", f"WITH {OUTCOMES} SELECT * EXCLUDE (budget_total) FROM m_outcome", M2_LINES)(lambda read: commit_tables(read)["outcome"])
query("m2_commit_churn", f"""WITH {OUTCOMES} SELECT o.repo_root, o.commit_sha, CASE WHEN merged_to_mainline_flag = 1 THEN budget_total ELSE 0 END AS ai_added_lines_reaching_mainline,
    CASE WHEN merged_to_mainline_flag = 1 THEN coalesce(g.gone, 0) ELSE 0 END AS ai_added_lines_removed_within_window, 14 AS window_days FROM m_outcome o LEFT JOIN m_gone g ON g.repo_root = o.repo_root AND g.commit_sha = o.commit_sha""", M2_LINES)(lambda read: commit_tables(read)["churn"])
query("m2_commit_bugs", f"""WITH {OUTCOMES} SELECT repo_root, commit_sha, 1 AS bug_after_merge_flag, first(ref ORDER BY fixed, ref) AS first_bug_signal_commit_sha, min(fixed) AS first_bug_signal_commit_time, count(*) AS bug_signal_count, 60 AS window_days,
    'git_fix_commit' AS signal_source FROM m_found GROUP BY ALL""", M2_LINES)(lambda read: commit_tables(read)["bug"])
query("m2_commit_sessions", f"""WITH {OUTCOMES} SELECT s.repo_root, s.commit_sha, s.provider, s.session_id, round(s.matched_lines, 5) AS matched_lines, round(s.share_of_commit, 5) AS share_of_commit, round(s.share_of_ai, 5) AS share_of_ai, p.commit_time,
    {nm("s.provider", "e.model_name")} AS model_name FROM shares s JOIN m_plain p ON p.repo_root = s.repo_root AND p.commit_sha = s.commit_sha LEFT JOIN sessions e ON e.provider = s.provider AND e.session_id = s.session_id""", M2_LINES)(
    lambda read: commit_tables(read)["commit_session"].withColumns({c: F.round(c, 5) for c in ("matched_lines", "share_of_commit", "share_of_ai")})
)
query("m8_rejected_merges", "SELECT repo_root, commit_sha, commit_time, 'merge commit' AS reason FROM commits WHERE event_id % 23 = 0", ("commits",))(lambda read: commit_tables(read)["rejected"])

# ---- incremental work

OLD_NEW = """WITH o AS (SELECT event_id // 7 AS id, md5(CAST(event_id AS VARCHAR)) AS line_hash, CAST(event_id % 3 AS BIGINT) AS count FROM events), n AS (SELECT event_id // 7 AS id, md5(CAST(event_id AS VARCHAR)) AS line_hash,
    CAST(CASE WHEN event_id % 10 = 0 THEN 9 ELSE event_id % 3 END AS BIGINT) AS count FROM events WHERE event_id % 50 <> 0)"""
query("h8_changed_multisets", f"{OLD_NEW} SELECT DISTINCT coalesce(o.id, n.id) AS id FROM o FULL JOIN n ON o.id = n.id AND o.line_hash = n.line_hash WHERE o.count IS DISTINCT FROM n.count")(lambda read: changed_multisets(read("base")))


def changed_multisets(base: DataFrame) -> DataFrame:
    old = base.select(F.floor(F.col("event_id") / 7).alias("id"), F.md5(F.col("event_id").cast("string")).alias("line_hash"), (F.col("event_id") % 3).alias("count"), "event_id")
    new = old.filter(F.col("event_id") % 50 != 0).withColumn("count", F.when(F.col("event_id") % 10 == 0, 9).otherwise(F.col("count")))
    return hashing.differs(old.drop("event_id"), new.drop("event_id"), ["id"], ["line_hash"])


#: A first read of the sessions lacks the sessions of some weeks, has fewer lines of others, and some that are gone later; it knows no commits of the last days.
NEW_ROWS = "(provider <> 'cursor' OR line_hash NOT LIKE '0%')"
OLD_ROWS = "(session_id NOT LIKE '%-01-08' AND line_hash NOT LIKE '1%')"
OLD_COMMITS = "commit_time < TIMESTAMP '2024-01-20 00:00:00'"


class Association:
    """An association of the first read, brought up to date with the second one; what of it isn't asked for isn't computed."""

    def __init__(self, read: Read, old_commits: str = OLD_COMMITS):
        self.rows, sessions = read("commit_hashes"), read("change_hashes")
        self.first, self.old, self.new = self.rows.filter(old_commits), sessions.filter(OLD_ROWS), sessions.filter(NEW_ROWS)
        self.matched = attribution.Matched(self.first, self.old)

    def stale(self) -> DataFrame:
        """The facts of the first read have a row for each of its commits."""
        return incremental.stale_commits(self.first.select("repo_root", "commit_sha").distinct(), self.rows, self.old, self.new)

    def facts(self) -> DataFrame:
        before = written(attribution.commit_facts(self.matched))
        return incremental.Reassociation(before, self.rows, self.old, self.new).facts(before)

    def shares(self) -> DataFrame:
        facts = written(attribution.commit_facts(self.matched))
        before = written(attribution.session_shares(self.matched, facts))
        return incremental.Reassociation(facts, self.rows, self.old, self.new).shares(before)


NOW = ATTRIBUTED.replace("FROM change_hashes", f"FROM (SELECT * FROM change_hashes WHERE {NEW_ROWS})")
query("i2_updated_facts", f"WITH {NOW} SELECT *, matched_added_lines + matched_removed_lines AS matched_total_lines, round((matched_added_lines + matched_removed_lines) / (total_added + total_removed), 6) AS ai_share, CASE WHEN (matched_added_lines + matched_removed_lines) / (total_added + total_removed) >= 0.5 THEN 1 ELSE 0 END AS heavy_ai FROM facts", LINES)(
    lambda read: Association(read).facts().withColumn("ai_share", F.round("ai_share", 6))
)
query("i2_updated_shares", f"WITH {NOW}{SHARES[len(ATTRIBUTED):]} SELECT repo_root, commit_sha, provider, session_id, round(matched_lines, 5) AS matched_lines, round(share_of_commit, 5) AS share_of_commit, round(share_of_ai, 5) AS share_of_ai FROM shares", LINES)(
    lambda read: Association(read).shares().withColumns({c: F.round(c, 5) for c in ("matched_lines", "share_of_commit", "share_of_ai")})
)
query("i2_recomputed_commits", f"""WITH o AS (SELECT repo_root, rel_path, side, line_hash, provider, session_id, max(count) AS n FROM change_hashes WHERE {OLD_ROWS} GROUP BY ALL), n AS (SELECT repo_root, rel_path, side, line_hash, provider, session_id, max(count) AS n FROM change_hashes WHERE {NEW_ROWS} GROUP BY ALL),
    d AS (SELECT repo_root, side, line_hash FROM (FROM o EXCEPT FROM n) UNION SELECT repo_root, side, line_hash FROM (FROM n EXCEPT FROM o)) SELECT DISTINCT repo_root, commit_sha FROM commit_hashes c WHERE NOT ({OLD_COMMITS}) OR EXISTS (SELECT 1 FROM d WHERE d.repo_root = c.repo_root AND d.side = c.side AND d.line_hash = c.line_hash)""", LINES)(lambda read: Association(read).stale())


def refreshed_shares(read: Read) -> DataFrame:
    """The commits' sessions as an event table that was built from the first read and of which the weeks with changes were replaced."""
    two, times = Association(read), read("commits").select("repo_root", "commit_sha", "commit_time")
    spark = times.sparkSession
    facts = written(attribution.commit_facts(two.matched))
    store = refresh.EventStore(spark, f"{own_folder(shared_folder(spark), spark.sparkContext.applicationId, spark)}/events-{uuid.uuid4().hex}")
    store.build("commit_session", attribution.session_shares(two.matched, facts, times), "commit_time")
    now = incremental.Reassociation(facts, two.rows, two.old, two.new)
    store.refresh("commit_session", now.shares(store.read("commit_session"), times), "commit_time", now.again.join(times, ["repo_root", "commit_sha"]))
    return store.read("commit_session")


query("snk3_refreshed_events", f"WITH {NOW}{SHARES[len(ATTRIBUTED):]} SELECT s.repo_root, s.commit_sha, provider, session_id, round(matched_lines, 5) AS matched_lines, round(share_of_commit, 5) AS share_of_commit, round(share_of_ai, 5) AS share_of_ai, commit_time FROM shares s JOIN commits c ON c.repo_root = s.repo_root AND c.commit_sha = s.commit_sha", (*LINES, "commits"))(
    lambda read: refreshed_shares(read).withColumns({c: F.round(c, 5) for c in ("matched_lines", "share_of_commit", "share_of_ai")})
)
query("i3_planned_commits", """SELECT repo_root, commit_sha, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 1 ELSE 0 END AS recompute, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE 1 END AS task_only FROM commits
    WHERE event_id % 5 = 0 OR event_id % 7 = 0 OR repo_root = '/repo/1'""", ("commits",))(
    lambda read: (lambda c: incremental.planned_commits(c.select("repo_root", "commit_sha"), c.filter("event_id % 5 <> 0").select("repo_root", "commit_sha"), c.filter("event_id % 7 = 0").select("repo_root", "commit_sha"), c.filter("repo_root = '/repo/1'").select("repo_root").distinct()))(read("commits"))
)
query("snk1_session_upsert", """SELECT provider, session_id, coalesce(max(CASE WHEN k = 1 THEN model_name END), max(CASE WHEN k = 0 THEN model_name END)) AS model_name, min(started_at) AS started_at, max(ended_at) AS ended_at FROM (
    SELECT provider, session_id, 0 AS k, max(model_name) AS model_name, min(ts) AS started_at, max(ts) AS ended_at FROM base WHERE event_id % 2 = 0 GROUP BY ALL
    UNION ALL SELECT provider, session_id, 1, max(model_name), min(ts), max(ts) FROM base WHERE event_id % 2 = 1 GROUP BY ALL) GROUP BY ALL""", ("base",))(
    lambda read: (lambda part: incremental.session_metadata(part(0), part(1)))(lambda k: read("base").filter(f"event_id % 2 = {k}").groupBy("provider", "session_id").agg(F.max("model_name").alias("model_name"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")))
)
query("i4_scan_starts", "SELECT repo_root, min(change_ts) - INTERVAL 1 DAY AS scan_from FROM changes WHERE repo_root IS NOT NULL GROUP BY ALL", ("changes",))(lambda read: incremental.scan_starts(read("changes")))
query("i5_lookups_to_retry", "SELECT c.* FROM (SELECT repo_key, commit_sha FROM ev_outcome) c WHERE NOT EXISTS (SELECT 1 FROM pr_lookups l WHERE l.status = 'resolved' AND l.repo_key = c.repo_key AND l.commit_sha = c.commit_sha)", ("ev_outcome", "pr_lookups"))(
    lambda read: incremental.lookups_to_retry(read("ev_outcome").select("repo_key", "commit_sha"), read("pr_lookups"))
)


# ---- scorecards


def card_sql(report: str, signals) -> str:
    def row(place: int, signal: tuple) -> str:
        name, number, total, unit, first, second, higher = signal
        m = f"CAST({number} AS DOUBLE)" if total is None else f"CASE WHEN {total} > 0 THEN {number} / {total} * 100 END"
        value = f"printf('%.2f', {m}) || '{unit}'" if total is None else f"printf('%.2f', {m}) || '% (' || {number} || '/' || {total} || ')'"
        band = f"CASE WHEN m IS NULL THEN 'n/a' WHEN m {'>=' if higher else '<'} {first} THEN 'good' WHEN m {'>=' if higher else '<='} {second} THEN 'watch' ELSE 'risk' END"
        return f"SELECT {place} AS place, '{name}' AS signal, coalesce(v, 'N/A') AS value, {band} AS status FROM (SELECT {m} AS m, CASE WHEN {m} IS NOT NULL THEN {value} END AS v FROM rep)"

    return f"WITH rep AS ({report}) " + " UNION ALL ".join(row(n, x) for n, x in enumerate(signals))


query("snk5_session_scorecard", card_sql(session_sql(V1, False, None, False), scorecards.SESSION), COMMIT_EVENTS)(lambda read: scorecards.scorecard(reports.session_report(event_tables(read), reports.ReportArgs()), scorecards.SESSION))
query("snk5_delivery_scorecard", card_sql(delivery_sql(V4, False, None, False), scorecards.DELIVERY), COMMIT_EVENTS)(lambda read: scorecards.scorecard(reports.delivery_report(event_tables(read), reports.ReportArgs()), scorecards.DELIVERY))
query("snk5_quality_scorecard", card_sql(quality_sql(V4, False, None, False), scorecards.QUALITY), COMMIT_EVENTS)(lambda read: scorecards.scorecard(reports.quality_report(event_tables(read), reports.ReportArgs()), scorecards.QUALITY))
