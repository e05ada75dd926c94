"""The engine's relations, derived from the tables at hand.

Each relation is SQL that Spark and other engines read alike, so a query and the
SQL it is checked against start from the same rows. `relation` gives one as a
DataFrame, `prelude` the common table expressions that lead to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSION_KEY = "'u' || CAST(user_id AS STRING) || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING)"
PROVIDER = "CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END"
MODEL = f"CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ({PROVIDER}) || '/m1' ELSE 'm2' END"
REPO = "CASE WHEN user_id % 5 = 4 THEN NULL ELSE '/repo/' || CAST(user_id % 5 AS STRING) END"
BRANCH = "CASE user_id % 6 WHEN 0 THEN 'PAC-12_x' WHEN 1 THEN 'feature/pac-7' WHEN 2 THEN 'codex/QRS-4-sort' WHEN 3 THEN 'plain' WHEN 4 THEN 'staging' ELSE 'develop' END"
#: A sha has 40 hexadecimal digits.
SHA = "md5('c' || CAST({0} AS STRING)) || substr(md5('d' || CAST({0} AS STRING)), 1, 8)"
#: Each row 40 times, with k from 0.
NUMBERS = {"spark": "LATERAL VIEW explode(sequence(0, 39)) v AS k", "sql": "CROSS JOIN (SELECT unnest(range(40)) AS k)"}

RELATIONS = {
    "base": f"""SELECT event_id, ts, user_id, event_type, value, {SESSION_KEY} AS session_id, {PROVIDER} AS provider, {MODEL} AS model_name, {REPO} AS repo_root,
        {BRANCH} AS branch FROM {{events}}""",
    "sessions": """SELECT provider, session_id, max(repo_root) AS repo_root, max(model_name) AS model_name, max(CASE WHEN user_id % 7 = 0 THEN ' ' ELSE repo_root END) AS project_path,
        min(CASE WHEN user_id % 11 <> 0 THEN ts END) AS started_at, max(CASE WHEN user_id % 4 <> 0 THEN ts END) AS ended_at FROM base GROUP BY provider, session_id""",
    "messages": """SELECT provider, session_id, 2 * event_id AS message_index, ts AS message_ts, CASE WHEN event_type = 'purchase' THEN 'system' ELSE 'user' END AS role,
            CASE event_type WHEN 'error' THEN 'ValueError: wrong shape of row ' || CAST(event_id % 100 AS STRING) WHEN 'view' THEN 'same error' WHEN 'click' THEN 'still failing'
                WHEN 'signup' THEN 'Please sort the columns ' || CAST(event_id % 9 AS STRING) ELSE 'note' END AS content FROM base
        UNION ALL SELECT provider, session_id, 2 * event_id + 1, ts, 'assistant', CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'try again' END FROM base WHERE event_id % 13 <> 0""",
    "changes": """SELECT provider, session_id, repo_root, event_id AS change_id, 'src/f' || CAST(event_id % 6 AS STRING) || '.py' AS rel_path, ts AS change_ts,
        CASE WHEN event_type = 'purchase' THEN 'tool_write' ELSE 'accepted_change' END AS source_kind, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 30 END AS lines_added,
        CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 7 END AS lines_removed FROM base WHERE event_type IN ('purchase', 'click')""",
    "change_hashes": """SELECT provider, session_id, repo_root, rel_path, '+' AS side, md5('line ' || CAST(CASE WHEN k < 32 THEN (change_id - change_id % 8) * 100 + k ELSE k END AS STRING)) AS line_hash,
        CAST(1 + k % 3 AS BIGINT) AS count FROM changes {numbers} WHERE k < 36 AND source_kind = 'tool_write' AND repo_root IS NOT NULL""",
    "commits": f"""SELECT repo_root, {SHA.format("event_id")} AS commit_sha, event_id, ts AS commit_time, user_id, branch,
        CASE event_type WHEN 'purchase' THEN 'add parser' ELSE CASE event_id % 3 WHEN 0 THEN 'fix parser' WHEN 1 THEN 'Revert x' || chr(10) || 'This reverts commit ' || {SHA.format("(event_id - event_id % 40 + 5 * (event_id % 8) + event_id % 5)")} || '.'
            ELSE 'update docs' END END AS message, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS on_mainline
        FROM base WHERE event_type IN ('purchase', 'error') AND repo_root IS NOT NULL""",
    "commit_hashes": """SELECT repo_root, commit_sha, commit_time, CASE WHEN event_id % 4 = 0 THEN 'lib/f' ELSE 'src/f' END || CAST(event_id % 6 AS STRING) || '.py' AS rel_path, '+' AS side,
            md5('line ' || CAST(CASE WHEN k < 32 THEN (event_id - event_id % 8) * 100 + k ELSE k END AS STRING)) AS line_hash, CAST(1 + k % 2 AS BIGINT) AS count, on_mainline
        FROM commits {numbers} WHERE event_type = 'purchase' AND k < CASE WHEN event_id % 6 = 1 THEN 12 ELSE 40 END
        UNION ALL SELECT repo_root, commit_sha, commit_time, 'src/f' || CAST(event_id % 3 AS STRING) || '.py', '-', md5('line ' || CAST(32 + (event_id + k) % 4 AS STRING)), CAST(1 + k % 2 AS BIGINT), on_mainline
        FROM commits {numbers} WHERE event_type = 'error' AND k < 4""",
    "branch_commits": """SELECT repo_root, branch, commit_sha, commit_time, CAST(row_number() OVER (PARTITION BY repo_root, branch ORDER BY commit_time DESC, commit_sha) - 1 AS BIGINT) AS distance,
            CASE WHEN event_id % 4 <> 3 THEN 1 ELSE 0 END AS on_first_parent
        FROM (SELECT repo_root, branch, commit_sha, commit_time, event_id FROM commits
              UNION ALL SELECT repo_root, 'main', commit_sha, commit_time, event_id FROM commits WHERE on_mainline = 1
              UNION ALL SELECT repo_root, 'XY-' || CAST(event_id % 12 AS STRING), commit_sha, commit_time, event_id FROM commits WHERE event_id % 3 = 1) AS b""",
    "pr_lookups": """SELECT repo_key, commit_sha, event_id, status, CASE WHEN status = 'resolved' THEN event_id END AS owning_pr_number FROM (
            SELECT CASE WHEN repo_root IN ('/repo/0', '/repo/1', '/repo/2') THEN 'git:github.com/acme/' ELSE 'git:gitlab.com/acme/' END || substr(repo_root, 7) AS repo_key, commit_sha, event_id,
                CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'no_pr' WHEN 2 THEN 'failed' ELSE 'resolved' END AS status FROM commits WHERE event_id % 5 <> 0) AS l""",
    "pulls": """SELECT repo_key, event_id AS pr_number, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS merged FROM pr_lookups WHERE status = 'resolved' AND event_id % 7 <> 0""",
    # event tables, for reports on their own
    "ev_quality": """SELECT provider, session_id, max(repo_root) AS repo_root, max(model_name) AS model_name, min(CASE WHEN user_id % 10 <> 9 THEN ts END) AS started_at, max(ts) AS ended_at,
        CASE WHEN max(user_id) % 9 = 0 THEN NULL ELSE count(*) END AS user_turn_count, max(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS debug_loop_flag,
        CASE WHEN max(user_id) % 8 = 0 THEN NULL ELSE max(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 1 ELSE 0 END) END AS mid_session_error_paste_flag,
        CASE WHEN max(user_id) % 13 = 0 THEN NULL ELSE max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) END AS accepted_output_flag,
        min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_accepted_change_at, min(CASE WHEN event_type = 'purchase' THEN CAST(event_id % 500 AS DOUBLE) / 4 END) AS minutes_to_first_accepted_change,
        max(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 1 ELSE 0 END) AS session_commit_within_4h_flag FROM base GROUP BY provider, session_id""",
    "ev_productivity": """SELECT provider, session_id, max(repo_root) AS repo_root, max(model_name) AS model_name, max(CASE WHEN user_id % 7 = 0 THEN ' ' ELSE repo_root END) AS project_path, min(ts) AS started_at,
        max(CASE WHEN user_id % 4 <> 0 THEN ts END) AS ended_at, CAST(sum(event_id % 20) AS BIGINT) AS accepted_lines_added, CAST(sum(event_id % 6) AS BIGINT) AS accepted_lines_removed,
        CAST(sum(event_id % 20 + event_id % 6) AS BIGINT) AS accepted_total_changed_lines, count(*) AS user_word_count FROM base GROUP BY provider, session_id""",
    "ev_outcome": """SELECT repo_root, CASE WHEN repo_root IN ('/repo/0', '/repo/1', '/repo/2') THEN 'git:github.com/acme/' ELSE 'git:gitlab.com/acme/' END || substr(repo_root, 7) AS repo_key, commit_sha, commit_time,
        CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS heavy_ai_flag, on_mainline AS merged_to_mainline_flag, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS reverted_later_flag,
        event_id % 400 AS commit_total_changed_lines FROM commits""",
    "ev_churn": "SELECT repo_root, commit_sha, event_id % 90 AS ai_added_lines_reaching_mainline, event_id % 30 AS ai_added_lines_removed_within_window FROM commits WHERE event_id % 17 <> 0",
    "ev_bug": """SELECT repo_root, commit_sha, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS bug_after_merge_flag, event_id % 3 AS bug_signal_count, md5(commit_sha) AS first_bug_signal_commit_sha,
        commit_time AS first_bug_signal_commit_time FROM commits WHERE event_id % 5 = 0""",
    "ev_commit_session": """SELECT c.repo_root, c.commit_sha, b.provider, b.session_id, b.model_name, c.commit_time, CAST(c.event_id % 40 AS DOUBLE) AS matched_lines, CAST(c.event_id % 8 AS DOUBLE) / 8 AS share_of_commit,
            CAST(0.75 AS DOUBLE) AS share_of_ai FROM commits c JOIN base b ON b.event_id = c.event_id
        UNION ALL SELECT c.repo_root, c.commit_sha, b.provider, b.session_id, b.model_name, c.commit_time, CAST(2 AS DOUBLE), CAST(0.125 AS DOUBLE), CAST(0.25 AS DOUBLE) FROM commits c JOIN base b ON b.event_id = c.event_id + 1
        UNION ALL SELECT repo_root, commit_sha, 'human', '__human__', NULL, commit_time, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM commits WHERE event_id % 19 = 0""",
    "ev_task_commit": """SELECT repo_root, CASE event_id % 5 WHEN 0 THEN 'PAC-' || CAST(event_id % 12 AS STRING) WHEN 1 THEN 'main' WHEN 2 THEN '(unknown)' ELSE 'AB-' || CAST(event_id % 3 AS STRING) END AS task_key, commit_sha,
        CASE event_id % 5 WHEN 1 THEN 'main' WHEN 2 THEN '(unknown)' ELSE branch END AS branch_name, CASE WHEN event_id % 5 IN (1, 2) THEN 1 ELSE 0 END AS fallback_flag, CAST(0.5 AS DOUBLE) AS confidence, commit_time FROM commits""",
    "ev_task_session": """SELECT t.repo_root, t.task_key, min(t.branch_name) AS branch_name, s.provider, s.session_id, max(s.model_name) AS model_name, max(q.started_at) AS started_at,
        sum(s.matched_lines) AS attribution_weight, max(CASE WHEN s.matched_lines > 9 THEN 1 ELSE 0 END) AS commit_within_window_flag, max(q.user_turn_count) AS user_turn_count, max(q.debug_loop_flag) AS debug_loop_flag,
        max(q.mid_session_error_paste_flag) AS mid_session_error_paste_flag, max(q.accepted_output_flag) AS accepted_output_flag, max(q.first_accepted_change_at) AS first_accepted_change_at,
        max(q.minutes_to_first_accepted_change) AS minutes_to_first_accepted_change
        FROM ev_task_commit t JOIN ev_commit_session s ON s.repo_root = t.repo_root AND s.commit_sha = t.commit_sha LEFT JOIN ev_quality q ON q.provider = s.provider AND q.session_id = s.session_id
        GROUP BY t.repo_root, t.task_key, s.provider, s.session_id""",
    "ev_pr_outcome": "SELECT repo_root, commit_sha, CASE WHEN event_id % 4 <> 1 THEN 1 ELSE 0 END AS pr_opened_flag, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS pr_merged_flag FROM commits WHERE event_id % 2 = 0",
    "ev_commit": "SELECT repo_root, commit_sha, event_id % 70 AS total_added, event_id % 20 AS total_removed FROM commits",
}
NEEDS = {
    "base": [], "sessions": ["base"], "messages": ["base"], "changes": ["base"], "change_hashes": ["base", "changes"], "commits": ["base"],
    "ev_quality": ["base"], "ev_productivity": ["base"], "ev_outcome": ["base", "commits"], "ev_churn": ["base", "commits"], "ev_bug": ["base", "commits"], "ev_commit_session": ["base", "commits"],
    "ev_task_commit": ["base", "commits"], "ev_task_session": ["base", "commits", "ev_quality", "ev_commit_session", "ev_task_commit"], "ev_pr_outcome": ["base", "commits"], "ev_commit": ["base", "commits"],
    "commit_hashes": ["base", "commits"], "branch_commits": ["base", "commits"], "pr_lookups": ["base", "commits"], "pulls": ["base", "commits", "pr_lookups"],
}


def prelude(*names: str, events: str = "events", dialect: str = "sql") -> str:
    """`WITH` and the named relations, after what they need."""
    wanted = {n for name in names for n in [name, *NEEDS[name]]}
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n].replace('{events}', events).replace('{numbers}', NUMBERS[dialect])})" for n in RELATIONS if n in wanted)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = f"parquet.`{sf_dir}/events.parquet`"
    return spark.sql(f"{prelude(name, events=events, dialect="spark")} SELECT * FROM {name}")
