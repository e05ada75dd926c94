"""The registered queries over derived logs, stores and hosted relations, and the SQL that each is held against.

The SQL tells from the events what the parsers have to find in the texts made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlens.functions import columns, hashing
from agentlens.operators import commit_graph, identity, incremental, outcomes, tables
from agentlens.queries import Read, query
from agentlens.sources import claude_logs, code_blocks, codex_logs, dead_letters, files, kv_store, model_names, patches, path_resolution, places, pull_files, store_changes
from agentlens.sources.log_relations import NEEDS, RELATIONS, SHA  # with the logs' relations

SECOND = "date_trunc('second', ts)"
NAMED = f"SELECT *, session_id || '.jsonl' AS source_file, {SECOND} AS t0 FROM placed_"
LINE = "md5('{0}')"


def plain(df: DataFrame) -> DataFrame:
    """Times without zone, as in the relations."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


def claude(read: Read) -> DataFrame:
    return claude_logs.records(read("claude_log"))


def codex(read: Read) -> DataFrame:
    return codex_logs.records(read("codex_log"))


C = f"WITH c AS ({NAMED}claude)"
X = f"WITH c AS ({NAMED}codex)"

query("p1_claude_sessions", f"""{C} SELECT source_file, coalesce(max(CASE WHEN event_type = 'signup' THEN session_id END), session_id) AS session_id, arg_max(coalesce(repo_root, ''), place) FILTER (event_type = 'signup') AS cwd,
    arg_max(CASE WHEN event_type = 'click' THEN 'm' || (event_id % 3) ELSE 'n1' END, place) FILTER (event_type = 'click' OR event_type = 'purchase' AND event_id % 2 = 1) AS model_name,
    min(t0) AS started_at, max(t0) AS ended_at FROM c WHERE event_type <> 'view' OR event_id % 2 = 0 GROUP BY source_file, c.session_id
    UNION ALL SELECT source_file, session_id, NULL, NULL, NULL, NULL FROM c GROUP BY source_file, session_id HAVING min(CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN 1 ELSE 0 END) = 1""", ("claude_log",))(lambda read: plain(claude_logs.sessions(claude(read))))
query("p2_claude_messages", f"""{C} SELECT source_file, CAST(3 * place AS BIGINT) AS message_index, t0 AS message_ts, CASE WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS role,
    CASE event_type WHEN 'signup' THEN 'Please sort  column ' || (event_id % 9) WHEN 'click' THEN 'done' ELSE 'one' || chr(10) || 'two' END AS content, CASE event_type WHEN 'signup' THEN 4 WHEN 'click' THEN 1 ELSE 2 END AS content_words
    FROM c WHERE event_type IN ('signup', 'click', 'purchase')""", ("claude_log",))(lambda read: plain(claude_logs.messages(claude(read))).withColumn("content_words", F.col("content_words").cast("int")))
query("p3_claude_tool_calls", f"""{C} SELECT source_file, CASE WHEN event_type = 'click' THEN 't' ELSE 'w' END || event_id AS call_id, CASE WHEN event_type = 'click' THEN 'Edit' ELSE 'Write' END AS name,
    event_type = 'click' AND event_id % 11 <> 0 AND event_id % 5 = 0 AS failed FROM c WHERE event_type IN ('click', 'purchase')""", ("claude_log",))(lambda read: claude_logs.tool_calls(claude(read)).select("source_file", "call_id", "name", "failed"))
EDITS = "event_type = 'click' AND event_id % 11 <> 0 AND event_id % 5 <> 0"
WRITES = "event_type = 'purchase' AND event_id % 7 <> 0"
query("p3_claude_writes", f"""{C} SELECT source_file, 't' || event_id AS call_id, '/r/f' || (event_id % 6) || '.py' AS path, t0 AS "at", 'patch' AS mode, true AS before_known, 2 AS lines_added, 1 AS lines_removed FROM c WHERE {EDITS}
    UNION ALL SELECT source_file, 'w' || event_id, '/r/g.py', t0, 'patch', true, 2, 2 FROM c WHERE {WRITES}""", ("claude_log",))(lambda read: plain(claude_logs.writes(claude_logs.tool_calls(claude(read)))[0]))
query("p4_claude_line_hashes", f"""{C}, h AS (SELECT source_file, 't' || event_id AS call_id, '/r/f' || (event_id % 6) || '.py' AS path, x.side, md5(x.line) AS line_hash, CAST(1 AS BIGINT) AS count FROM c, unnest([{{'side': '-', 'line': 'b'}}, {{'side': '+', 'line': 'c' || (event_id % 4)}}, {{'side': '+', 'line': 'd'}}]) AS u(x) WHERE {EDITS}
    UNION ALL SELECT source_file, 'w' || event_id, '/r/g.py', '+', md5('z' || (event_id % 4)), 2 FROM c WHERE {WRITES} UNION ALL SELECT source_file, 'w' || event_id, '/r/g.py', '-', md5('y'), 1 FROM c WHERE {WRITES}
    UNION ALL SELECT source_file, 'w' || event_id, '/r/g.py', '-', md5('q'), 1 FROM c WHERE {WRITES}) SELECT * FROM h""", ("claude_log",))(lambda read: claude_logs.writes(claude_logs.tool_calls(claude(read)))[1])

query("p6_codex_sessions", f"""{X} SELECT source_file, session_id, '/w' AS cwd, NULL AS model_provider, arg_min('m' || (event_id % 3), place) FILTER (event_type = 'view') AS model_name, min(t0) AS started_at, max(t0) AS ended_at FROM c GROUP BY source_file, session_id""", ("codex_log",))(
    lambda read: plain(codex_logs.sessions(codex(read)))
)
query("p6_codex_messages", f"""{X} SELECT source_file, CAST(1 + 3 * place AS BIGINT) AS message_index, t0 AS message_ts, CASE WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN event_type = 'signup' THEN 'do it again' ELSE 'a' || (event_id % 2) || ' b' END AS content, CASE WHEN event_type = 'signup' THEN 3 ELSE 2 END AS content_words FROM c WHERE event_type = 'purchase' OR event_type = 'signup' AND event_id % 3 <> 0""", ("codex_log",))(
    lambda read: plain(codex_logs.messages(codex(read))).withColumn("content_words", F.col("content_words").cast("int"))
)
query("p8_codex_tool_calls", f"""{X} SELECT source_file, CASE WHEN event_type = 'click' THEN 'p' ELSE 'x' END || event_id AS call_id, CASE WHEN event_type = 'click' THEN 'apply_patch' ELSE 'exec_command' END AS name, t0 AS "at"
    FROM c WHERE event_type = 'click' AND event_id % 3 = 0 OR event_type = 'error' AND event_id % 2 = 0 AND event_id % 7 <> 0""", ("codex_log",))(lambda read: plain(codex_logs.tool_calls(codex(read)).select("source_file", "call_id", "name", "at")))
PATCHED = "event_type = 'click' AND event_id % 3 = 0"


def patched(read: Read):
    return patches.apply_patch(codex_logs.tool_calls(codex(read)).filter("name = 'apply_patch'"), ["source_file", "call_id"], "input")


query("p9_patch_operations", f"""{X} SELECT source_file, 'p' || event_id AS call_id, CAST(x.i AS BIGINT) AS op_index, x.path, x.a AS added_lines, x.r AS removed_lines FROM c,
    unnest([{{'i': 0, 'path': 'a' || (event_id % 6) || '.py', 'a': 2, 'r': 1}}, {{'i': 1, 'path': 'n.py', 'a': 0, 'r': 0}}, {{'i': 2, 'path': 'b.py', 'a': 1, 'r': 0}}]) AS u(x) WHERE {PATCHED}""", ("codex_log",))(lambda read: patched(read)[0])
query("p9_patch_hashes", f"""{X} SELECT source_file, 'p' || event_id AS call_id, CAST(x.i AS BIGINT) AS op_index, x.side, md5(x.line) AS line_hash, CAST(1 AS BIGINT) AS count FROM c,
    unnest([{{'i': 0, 'side': '-', 'line': 'old'}}, {{'i': 0, 'side': '+', 'line': 'new' || (event_id % 4)}}, {{'i': 0, 'side': '+', 'line': 'more'}}, {{'i': 2, 'side': '+', 'line': 'b'}}]) AS u(x) WHERE {PATCHED}""", ("codex_log",))(lambda read: patched(read)[1])
COMMANDS = "event_type = 'error' AND event_id % 2 = 0 AND event_id % 7 <> 0"


def written_files(read: Read) -> DataFrame:
    return patches.heredocs(codex_logs.commands(codex_logs.tool_calls(codex(read))), ["source_file", "line_no"], "cmd")


DOCS = f"""docs AS (SELECT source_file, CAST(1 + 3 * place AS BIGINT) AS line_no, 0 AS doc_index, 'overwrite' AS mode, 'f.txt' AS path, 'x' || (event_id % 4) || chr(10) || 'y' || chr(10) AS content FROM c WHERE {COMMANDS}
    UNION ALL SELECT source_file, CAST(1 + 3 * place AS BIGINT), 1, 'append', 'f.txt', 'z' || chr(10) FROM c WHERE {COMMANDS})"""
query("p10_written_files", f"{X}, {DOCS} SELECT * FROM docs", ("codex_log",))(written_files)
query("p10_texts_before_writes", f"""{X}, {DOCS} SELECT *, CASE WHEN mode = 'append' THEN lag(content) OVER w ELSE lag(content, 2) OVER w || lag(content) OVER w END AS before FROM docs WINDOW w AS (PARTITION BY source_file ORDER BY line_no, doc_index)""", ("codex_log",))(
    lambda read: patches.heredoc_changes(written_files(read), ["source_file"], ["line_no", "doc_index"])
)

ON_DIFFS = "FROM diff_texts, unnest([{0}]) AS u(x)"
query("src11_commit_files", "SELECT commit_sha, x.p AS rel_path, x.k AS change_type, x.a AS added_lines, x.r AS removed_lines " + ON_DIFFS.format("{'p': 'src/f' || (event_id % 6) || '.py', 'k': 'modify', 'a': 2, 'r': 1}, {'p': 'n.py', 'k': 'rename', 'a': 0, 'r': 0}, {'p': 'd.py', 'k': 'delete', 'a': 0, 'r': 1}"), ("diff_texts",))(
    lambda read: patches.unified_diff(read("diff_texts"), ["commit_sha"], "patch")[0]
)
query("src11_commit_hashes", "SELECT commit_sha, x.p AS rel_path, x.s AS side, md5(x.line) AS line_hash, CAST(x.n AS BIGINT) AS count " + ON_DIFFS.format("{'p': 'src/f' || (event_id % 6) || '.py', 's': '-', 'line': 'a', 'n': 1}, {'p': 'src/f' || (event_id % 6) || '.py', 's': '+', 'line': 'b' || (event_id % 4), 'n': 2}, {'p': 'd.py', 's': '-', 'line': 'gone', 'n': 1}"), ("diff_texts",))(
    lambda read: patches.unified_diff(read("diff_texts"), ["commit_sha"], "patch")[1]
)


def store(read: Read) -> DataFrame:
    return kv_store.entries(read("store_rows"))


U = "WITH c AS (SELECT * FROM base WHERE provider = 'cursor'), h AS (SELECT session_id, min(event_id) AS lo, max(event_id) AS hi FROM c GROUP BY session_id)"
query("p12_store_sessions", f"{U} SELECT session_id, to_timestamp(min(event_id)) AT TIME ZONE 'UTC' AS started_at, coalesce(max(CASE WHEN event_type = 'click' THEN 'named' END), '') AS model_name, 2 AS n_headers FROM c GROUP BY session_id", ("store_rows",))(
    lambda read: plain(kv_store.sessions(store(read)).select("session_id", "started_at", "model_name", F.size("headers").alias("n_headers")))
)
query("p13_store_messages", f"""{U} SELECT c.session_id, CASE c.event_id WHEN h.lo THEN 1 WHEN h.hi THEN 0 END AS message_index, CASE WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN event_type = 'signup' THEN 'please  go on' ELSE 'sure' END AS content,
    CASE WHEN event_type = 'signup' THEN 3 ELSE 1 END AS content_words FROM c JOIN h ON h.session_id = c.session_id WHERE (event_type = 'view' OR event_type = 'signup' AND event_id % 4 <> 0)""", ("store_rows",))(
    lambda read: kv_store.messages(store(read)).select("session_id", "message_index", "role", "content", F.col("content_words").cast("int").alias("content_words"))
)
query("p15_store_edits", f"""{U} SELECT c.session_id, '/r/f' || (event_id % 6) || '.py' AS path, 2 * count(*) AS lines_added, count(*) AS lines_removed FROM c WHERE event_type = 'click' AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 2 GROUP BY ALL""", ("store_rows",))(
    lambda read: kv_store.tool_edits(store(read))
)
query("p23_accepted_lines", f"{U} SELECT session_id, CAST(event_id AS VARCHAR) AS item, '/r/p' || (event_id % 4) AS path, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS lines_added FROM c WHERE event_type = 'error'", ("store_rows",))(
    lambda read: kv_store.accepted_fates(store(read)).select("session_id", "item", "path", F.size("added").alias("lines_added"))
)

query("h3_line_diffs", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END + 1 AS added, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS removed FROM base", ("base",))(
    lambda read: hashing.with_line_diff(read("base").select("event_id", F.concat(F.lit("a\x0cb\n"), F.col("event_id").cast("string"), F.lit("\nlast")).alias("x"), F.concat(F.lit("a\x0cb\n"), (F.col("event_id") + F.when(F.col("event_id") % 3 == 0, 0).otherwise(1)).cast("string"), F.lit("\nlast\nand more\n")).alias("y")), "x", "y").select("event_id", F.col("added").cast("int").alias("added"), F.col("removed").cast("int").alias("removed"))
)
FORMER = "CASE WHEN status = 'renamed' THEN previous_filename ELSE filename END"
query("h9_pull_removed_lines", f"SELECT repo_key, pr_number, {FORMER} AS rel_path, md5(x) AS line_hash, count(*) AS count FROM pull_files, unnest(['x' || (pr_number % 5), 'same']) AS u(x) WHERE patch IS NOT NULL GROUP BY ALL", ("pull_files",))(lambda read: pull_files.removed_hashes(read("pull_files"))[0])
query("h9_pull_complete", "SELECT repo_key, pr_number, CASE WHEN patch IS NOT NULL OR status = 'added' THEN 1 ELSE 0 END AS removed_hashes_complete_flag FROM pull_files", ("pull_files",))(lambda read: pull_files.removed_hashes(read("pull_files"))[1])


def hosted_signals(read: Read) -> DataFrame:
    hashes, complete = pull_files.removed_hashes(read("pull_files"))
    pulls = complete.withColumn("repo_root", F.concat(F.lit("/repo/"), F.substring("repo_key", 2, 9))).withColumn("merged_at", F.when(F.col("pr_number") % 4 != 1, F.lit("2024-03-01").cast("timestamp_ntz")))
    return outcomes.issue_signals(read("issues"), outcomes.first_links(read("issue_timeline")), pulls, hashes)


BUGS = f"""WITH b AS (SELECT i.repo_key, i.issue_number, f.pr_number, {FORMER} AS rel_path, f.patch FROM issues i JOIN pull_files f ON f.repo_key = i.repo_key AND f.pr_number = i.issue_number
    WHERE bug_candidate_flag = 1 AND is_pull_request_flag = 0 AND patch IS NOT NULL AND f.pr_number % 4 <> 1)"""
query("j14_issue_signals", f"""{BUGS} SELECT '/repo/' || substr(repo_key, 2) AS repo_root, rel_path, md5(x) AS line_hash, CAST(1 AS BIGINT) AS count, 'issue#' || issue_number || '/pr#' || pr_number AS signal_ref, 'github_issue_fix_pr_exact_hash' AS source
    FROM b, unnest(['x' || (pr_number % 5), 'same']) AS u(x)""", ("issues", "pull_files"))(lambda read: hosted_signals(read).select("repo_root", "rel_path", "line_hash", "count", "signal_ref", "source"))
query("j13_issue_bugs", f"""{BUGS}, s AS (SELECT DISTINCT '/repo/' || substr(repo_key, 2) AS repo_root, rel_path, md5('same') AS line_hash, 'issue#' || issue_number || '/pr#' || pr_number AS ref FROM b),
    w AS (SELECT event_id, 'c' || event_id AS commit_sha, '/repo/' || (user_id % 3) AS repo_root, CASE WHEN event_id % 2 = 0 THEN 'a.py' ELSE 'old.py' END AS rel_path, date_trunc('day', ts) AS t FROM base)
    SELECT w.repo_root, commit_sha, count(*) AS bug_signal_count, min(ref) AS first_bug_signal_commit_sha FROM w JOIN s ON s.repo_root = w.repo_root AND s.rel_path = w.rel_path WHERE TIMESTAMP '2024-03-01' > t AND TIMESTAMP '2024-03-01' <= t + INTERVAL 60 DAY GROUP BY ALL""", ("issues", "pull_files"))(
    lambda read: outcomes.bugs_after(read("base").select(F.concat(F.lit("/repo/"), F.col("user_id") % 3).alias("repo_root"), F.concat(F.lit("c"), "event_id").alias("commit_sha"), F.when(F.col("event_id") % 2 == 0, "a.py").otherwise("old.py").alias("rel_path"),
        F.md5(F.lit("same")).alias("line_hash"), F.lit(1).cast("bigint").alias("budget"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("commit_time")), hosted_signals(read)).select("repo_root", "commit_sha", "bug_signal_count", "first_bug_signal_commit_sha")
)
query("a25_owning_pulls", "SELECT repo_key, commit_sha, first(pr_number ORDER BY created_at IS NULL, created_at, pr_number) AS owning_pr_number FROM pulls_of_commit GROUP BY repo_key, commit_sha", ("pulls_of_commit",))(lambda read: outcomes.owning_pull(read("pulls_of_commit")))
query("a26_first_links", "SELECT repo_key, issue_number, pr_number, first(linked_at ORDER BY linked_at IS NULL, position) AS linked_at FROM issue_timeline GROUP BY repo_key, issue_number, pr_number", ("issue_timeline",))(lambda read: outcomes.first_links(read("issue_timeline")))
query("a27_running_index", """WITH k AS (SELECT provider, session_id, CAST(max(event_id) % 7 AS BIGINT) AS last FROM base WHERE user_id % 2 = 0 GROUP BY ALL) SELECT c.provider, c.session_id, c.change_id, coalesce(k.last + 1, 0) + row_number() OVER (PARTITION BY c.provider, c.session_id ORDER BY c.change_ts, c.change_id) - 1 AS change_index
    FROM changes c LEFT JOIN k ON k.provider = c.provider AND k.session_id = c.session_id""", ("changes",))(
    lambda read: incremental.running_index(read("changes"), read("base").filter("user_id % 2 = 0").groupBy("provider", "session_id").agg((F.max("event_id") % 7).alias("change_index"))).select("provider", "session_id", "change_id", "change_index")
)
query("a22_repositories", "SELECT count(DISTINCT repo_root) AS n_repositories FROM commits", ("commits",))(lambda read: incremental.repositories(read("commits")))
query("a23_issue_scan_starts", "SELECT repo_root, min(commit_time) AS scan_from FROM commits GROUP BY repo_root", ("commits",))(lambda read: incremental.issue_scan_starts(read("commits")))
query("i1_changed_files", """SELECT f.* FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM file_cursors c WHERE c.provider = 'p1' AND c.source_file = f.path AND c.file_mtime = f.mtime AND c.file_size = f.size)""", ("source_files", "file_cursors"))(lambda read: incremental.changed_files(read("source_files"), read("file_cursors"), "p1"))
query("i1_advanced_cursors", """SELECT provider, source_file, file_mtime, file_size FROM file_cursors WHERE provider <> 'p1' UNION ALL SELECT 'p1', path, mtime, size FROM source_files""", ("source_files", "file_cursors"))(lambda read: incremental.advanced_cursors(read("file_cursors"), read("source_files"), "p1"))
query("i7_new_sessions", "SELECT DISTINCT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM base WHERE event_id % 40 = 0)", ("sessions",))(lambda read: incremental.new_sessions(read("sessions").select("session_id").distinct(), read("base").filter("event_id % 40 = 0")))
#: Line hashes of a source, read twice: operations came, went and changed in between.
OPS = "SELECT event_id AS op_id, coalesce(repo_root, '') AS repo_root, '+' AS side, md5(CAST(event_id % 97 AS STRING)) AS line_hash, CAST({0} AS BIGINT) AS count FROM base WHERE {1}"
DIRTY = f"""o AS ({OPS.format("1", "event_id % 13 <> 0")}), n AS ({OPS.format("CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END", "event_id % 19 <> 0")}),
    g AS (SELECT DISTINCT coalesce(o.op_id, n.op_id) AS op_id FROM o FULL JOIN n ON n.op_id = o.op_id AND n.line_hash = o.line_hash AND n.repo_root = o.repo_root WHERE o.count IS DISTINCT FROM n.count)"""


def operations(read: Read, count: Column, test: str) -> DataFrame:
    return read("base").filter(test).select(F.col("event_id").alias("op_id"), F.coalesce("repo_root", F.lit("")).alias("repo_root"), F.lit("+").alias("side"), F.md5((F.col("event_id") % 97).cast("string")).alias("line_hash"), count.cast("bigint").alias("count"))


def read_twice(read: Read) -> tuple[DataFrame, DataFrame]:
    return operations(read, F.lit(1), "event_id % 13 <> 0"), operations(read, F.when(F.col("event_id") % 17 == 0, 2).otherwise(1), "event_id % 19 <> 0")


query("i2_dirty_hashes", f"WITH {DIRTY} SELECT DISTINCT repo_root, side, line_hash FROM (SELECT * FROM o UNION ALL SELECT * FROM n) WHERE op_id IN (SELECT op_id FROM g)", ("base",))(lambda read: incremental.dirty_hashes(*read_twice(read), ["op_id"]))
query("i2_reconciled_operations", f"""WITH {DIRTY} SELECT n.op_id, CASE WHEN g.op_id IS NULL THEN 3 ELSE 4 END AS version FROM n LEFT JOIN g ON g.op_id = n.op_id""", ("base",))(
    lambda read: (lambda o, n: incremental.reconciled(o.withColumn("version", F.lit(3)), n, ["op_id"], 4)[0].select("op_id", "version").distinct())(*read_twice(read))
)
query("i2_stale_operations", f"WITH {DIRTY} SELECT DISTINCT op_id FROM o WHERE op_id NOT IN (SELECT op_id FROM n)", ("base",))(lambda read: (lambda o, n: incremental.reconciled(o.withColumn("version", F.lit(3)), n, ["op_id"], 4)[1].select("op_id"))(*read_twice(read)))
query("j16_dirty_commits", """SELECT DISTINCT h.repo_root, h.commit_sha FROM commit_hashes h JOIN (SELECT DISTINCT repo_root, side, line_hash FROM change_hashes WHERE provider = 'codex' AND count = 2) d ON d.repo_root = h.repo_root AND d.side = h.side AND d.line_hash = h.line_hash""", ("commit_hashes", "change_hashes"))(
    lambda read: incremental.dirty_commits(read("commit_hashes"), read("change_hashes").filter("provider = 'codex' AND count = 2").select("repo_root", "side", "line_hash").distinct())
)
query("u4_first_of_key", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id FROM base GROUP BY user_id", ("base",))(lambda read: incremental.first_of_key(read("base"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id"))

# ---- records of the store beyond tool calls

query("p16_project_paths", """SELECT session_id, CASE WHEN count(DISTINCT event_id % 3) = 1 THEN '/repo/x/d' || min(event_id % 3) ELSE '/repo/x' END AS project_path FROM base GROUP BY session_id""", ("base",))(
    lambda read: store_changes.project_paths(read("base").select("session_id", F.lit(0).alias("source"), F.concat(F.lit("file:///repo/x/d"), F.col("event_id") % 3, F.lit("/f"), F.col("event_id"), F.lit(".py")).alias("path")).unionByName(read("base").select("session_id", F.lit(1).alias("source"), F.lit("/other").alias("path"))).unionByName(read("base").select("session_id", F.lit(0).alias("source"), F.concat(F.lit("/repo/x/d"), F.col("event_id") % 3, F.lit("/g.py")).alias("path"))))
)
query("p17_model_names", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gpt-' || (event_id % 7) WHEN 1 THEN 'default' WHEN 2 THEN 'Claude-' || (event_id % 5) END AS model_name FROM base""", ("base",))(
    lambda read: read("base").select("event_id", F.concat(F.lit('{"a":[{"defaultModel":"default"},{"model":{"name":" '), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("gpt-"), F.col("event_id") % 7)).otherwise("none"), F.lit(' "}}],"b":{"chatModel":"'), F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("Claude-"), F.col("event_id") % 5)).otherwise("x"), F.lit('"}}')).alias("v"), F.col("event_id").alias("e"))
    .withColumn("v", F.when(F.col("e") % 4 == 3, F.lit('{"model":"mine"}')).otherwise(F.col("v"))).select("event_id", store_changes.model_name("v").alias("model_name"))
)
BLOCKS = """SELECT session_id, event_id, '{"file:///r/f' || CAST(event_id % 6 AS STRING) || '.py":[{"status":"accepted","partialInlineDiffFatesId":"p' || CAST(event_id AS STRING) || '","version":2,"content":"x' || CAST(event_id AS STRING) || '"},{"status":"accepted","isNoOp":true,"diffId":"d"},{"status":"rejected"}],"/r/g.py":{"0":{"status":"accepted","content":"y","codeBlockIdx":1}}}' AS value FROM base WHERE event_type = 'click'"""
RELATIONS["code_blocks"], NEEDS["code_blocks"] = BLOCKS, ["base"]
query("p18_targets", """SELECT event_id AS session_id, x.path, CASE WHEN x.k = 0 THEN 'p' || event_id END AS partial_id, CASE WHEN x.k = 1 THEN 'd' END AS diff_id, CASE x.k WHEN 0 THEN 'x' || event_id WHEN 2 THEN 'y' END AS content, CASE WHEN x.k = 0 THEN 2 ELSE 0 END AS version, CASE WHEN x.k = 2 THEN 1 ELSE 0 END AS idx, x.k <> 1 AS applied
    FROM code_blocks, unnest([{'k': 0, 'path': '/r/f' || (event_id % 6) || '.py'}, {'k': 1, 'path': '/r/f' || (event_id % 6) || '.py'}, {'k': 2, 'path': '/r/g.py'}]) AS u(x)""", ("code_blocks",))(lambda read: store_changes.targets(read("code_blocks").withColumn("session_id", F.col("event_id")), "value"))
query("p20_history_lines", """SELECT 's' AS session_id, 'f' || (user_id % 50) AS path, count(*) AS lines_added, count(*) AS lines_removed FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS after FROM base) WHERE event_id % 3 = 0 AND event_id >= 100 AND after IS NOT NULL GROUP BY ALL""", ("base",))(
    lambda read: store_changes.history_lines(*(lambda h: (h.drop("_last"), h.filter("_last = id").select(F.lit("s").alias("session_id"), "path", F.lit(100).alias("begin_ms"), (F.col("_last") - 1).alias("end_ms"))))(
        read("base").select(F.concat(F.lit("f"), F.col("user_id") % 50).alias("path"), F.col("event_id").alias("id"), F.col("event_id").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, "Undo edit").otherwise("Edit").alias("source"), F.concat(F.lit("a\n"), F.col("event_id"), F.lit("\nb\n")).alias("content"), F.max("event_id").over(Window.partitionBy(F.col("user_id") % 50)).alias("_last"))))
)
query("p22_inline_changes", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c,d' WHEN 1 THEN 'z' || event_id ELSE '' END AS added, CASE WHEN event_id % 4 = 1 THEN 'q' ELSE '' END AS removed, CASE event_id % 4 WHEN 2 THEN 'a range out of bounds' WHEN 3 THEN 'no changes' END AS error FROM base""", ("base",))(
    lambda read: store_changes.inline_changes(read("base").select("event_id", F.concat(F.lit('{"newTextLines":["b","c","d"],'), F.when(F.col("event_id") % 4 == 0, F.lit('"changes":[{"addedRange":{"startLineNumber":2,"endLineNumberExclusive":4}}]')).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"changes":[{"addedTextLines":["z'), F.col("event_id"), F.lit('"],"removedTextLines":["q"]}]')))
        .when(F.col("event_id") % 4 == 2, F.lit('"changes":[{"addedRange":{"startLineNumber":2,"endLineNumberExclusive":5}}]')).otherwise('"other":1'), F.lit("}")).alias("value")), ["event_id"]).withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})
)
SCORES = [("historical_removed", 2), ("live_added", 3), ("live_removed", 3), ("checkpoint", 2), ("strong_hint", 2), ("weak_hint", 2), ("basename", 2), ("proximity", 4)]
RELATIONS["path_candidates"] = "SELECT user_id AS session_id, CAST(event_id % 3 AS STRING) AS item, '/r/' || CAST(event_id AS STRING) AS path, " + ", ".join(f"CAST((event_id * {2 * k + 7} + event_id % {k + 11}) % {m} AS INT) AS {n}" for k, (n, m) in enumerate(SCORES)) + " FROM base"
NEEDS["path_candidates"] = ["base"]
RANKED = ", ".join(f"{n} DESC" for n, _ in SCORES)
query("p25_confident_paths", f"""WITH s AS (SELECT *, 100 * historical_removed + 10 * live_added + live_removed AS a, 100 * checkpoint + 10 * strong_hint + 5 * weak_hint + 2 * basename + proximity AS b, ({", ".join(n for n, _ in SCORES)}) AS r FROM path_candidates),
    o AS (SELECT *, row_number() OVER w AS place, lead(a) OVER w AS na, lead(b) OVER w AS nb, lead(r) OVER w AS nr FROM s WINDOW w AS (PARTITION BY session_id, item ORDER BY {RANKED}, path))
    SELECT session_id, item, path FROM o WHERE place = 1 AND a > 0 AND CASE WHEN na IS NULL THEN historical_removed > 0 OR live_added > 0 OR live_removed >= 2 WHEN r = nr THEN false WHEN a > na THEN historical_removed > 0 OR live_added > 0 OR live_removed >= 2
        ELSE a = na AND b > nb AND (historical_removed > 0 OR live_added >= 2 OR live_removed >= 2) END""", ("path_candidates",))(lambda read: store_changes.confident_paths(read("path_candidates")))
query("p27_block_versions", """SELECT user_id AS session_id, 'f' AS path, count(*) AS lines_added, count(*) - 1 AS lines_removed FROM base GROUP BY user_id""", ("base",))(
    lambda read: store_changes.legacy_changes(read("base").select(F.col("user_id").alias("session_id"), F.lit("f").alias("path"), F.lit(None).cast("string").alias("diff_id"), F.concat(F.lit("v"), F.col("event_id")).alias("content"), F.col("event_id").cast("int").alias("version"), F.lit(0).alias("idx"), F.lit(True).alias("applied")))
)

# ---- paths of partial diffs that name none

S = lambda x: f"CAST({x} AS STRING)"
RELATIONS |= {
    "partial_lines": f"""SELECT user_id AS session_id, event_id AS item, '+' AS side, 'value = ' || {S("event_id % 9")} AS line FROM base WHERE event_type = 'error'
        UNION ALL SELECT user_id, event_id, '+', CASE event_id % 3 WHEN 0 THEN 'return None' WHEN 1 THEN 'import os' ELSE 'x = 1' END FROM base WHERE event_type = 'error'
        UNION ALL SELECT user_id, event_id, '+', '}}' FROM base WHERE event_type = 'error' AND event_id % 2 = 0 UNION ALL SELECT user_id, event_id, '-', 'old ' || {S("event_id % 5")} FROM base WHERE event_type = 'error' AND event_id % 4 <> 0""",
    "hint_rows": f"""SELECT user_id AS session_id, event_id AS hint_id, '/repo/' || {S("user_id % 2")} || '/src/f' || {S("CASE WHEN user_id % 6 = 2 THEN 0 ELSE n END")} || '.py' AS path, n FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM base WHERE event_type = 'click') AS c WHERE CASE user_id % 6 WHEN 0 THEN n = 1 WHEN 3 THEN false WHEN 4 THEN false ELSE n <= 3 END""",
    "hint_lines": f"SELECT session_id, hint_id, 'old ' || {S('(n + session_id) % 5')} AS line FROM hint_rows WHERE n <> 3 UNION ALL SELECT session_id, hint_id, 'kept' FROM hint_rows WHERE n <> 3",
    "named_paths": f"""SELECT DISTINCT user_id AS session_id, '/repo/' || {S("user_id % 2")} || CASE WHEN event_id % 3 = 0 THEN '/src/f' ELSE '/lib/f' END || {S("CASE WHEN user_id % 12 IN (3, 10) THEN 1 ELSE event_id % 4 END")} || '.py' AS path,
        CASE user_id % 6 WHEN 3 THEN 'strong' WHEN 4 THEN 'weak' ELSE 'checkpoint' END AS kind FROM base WHERE user_id % 6 IN (1, 3, 4) AND (user_id % 12 NOT IN (3, 10) OR event_id % 3 = 0) AND event_type IN ('view', 'signup') AND (user_id % 6 <> 1 OR user_id % 5 = 0)""",
    "original_states": f"SELECT DISTINCT user_id AS session_id, '/repo/' || {S('user_id % 2')} || '/src/f' || {S('event_id % 3')} || '.py' AS path, 'old ' || {S('user_id % 5')} || chr(10) || 'old ' || {S('event_id % 3')} || chr(10) AS content FROM base WHERE user_id % 3 = 1",
    "seen_paths": f"SELECT DISTINCT user_id AS session_id, '/repo/' || {S('user_id % 2')} || '/src/f1.py' AS path FROM base WHERE user_id % 7 = 0",
    "repo_files": f"""SELECT DISTINCT '/repo/' || {S("user_id % 2")} AS repo_root, '/repo/' || {S("user_id % 2")} || CASE WHEN event_id % 10 > 7 THEN '/node_modules/f' WHEN event_id % 10 > 3 THEN '/lib/f' ELSE '/src/f' END || {S("event_id % 4")} || '.py' AS path,
        'import os' || chr(10) || 'value = ' || {S("event_id % 10")} || chr(10) || 'return None' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'value = ' || {S("event_id % 10 + 1")} ELSE 'old ' || {S("event_id % 10 - 1")} END || chr(10) || '}}' || chr(10) AS content FROM base""",
}
NEEDS |= {"partial_lines": ["base"], "hint_rows": ["base"], "hint_lines": ["base", "hint_rows"], "named_paths": ["base"], "original_states": ["base"], "seen_paths": ["base"], "repo_files": ["base"]}
PARTIAL = ("partial_lines", "hint_lines", "named_paths", "original_states", "seen_paths", "repo_files")


def partial_hints(read: Read) -> DataFrame:
    lines = read("hint_lines").groupBy("session_id", "hint_id").agg(F.collect_list("line").alias("original_lines"))
    return read("hint_rows").join(lines, ["session_id", "hint_id"], "left").select("session_id", "hint_id", "path", F.coalesce("original_lines", F.array().cast("array<string>")).alias("original_lines"))


def resolved_partials(read: Read) -> tuple[DataFrame, DataFrame]:
    return path_resolution.resolved(read("partial_lines"), partial_hints(read), read("named_paths"), read("original_states"), read("seen_paths"), read("repo_files"))


TELLING = "len(trim(line)) >= 3 AND regexp_matches(line, '[A-Za-z0-9]')"
INDEX = f"""idx AS (SELECT repo_root, path, line, count(*) AS n FROM (SELECT repo_root, path, unnest(string_split(content, chr(10))) AS line FROM repo_files WHERE NOT contains(path, '/node_modules/')) WHERE {TELLING} GROUP BY ALL)"""
#: Each rung from the relations themselves; the last one tries every file that shares a line.
LADDER = f"""WITH items AS (SELECT DISTINCT session_id, item FROM partial_lines), inline_ AS (SELECT * FROM hint_rows ANTI JOIN seen_paths USING (session_id, path)), known AS (SELECT * FROM named_paths ANTI JOIN seen_paths USING (session_id, path)),
    sc AS (SELECT i.session_id, i.item, h.hint_id, h.path, (SELECT count(*) FROM partial_lines p WHERE p.session_id = i.session_id AND p.item = i.item AND p.side = '-' AND EXISTS (SELECT 1 FROM hint_lines l WHERE l.hint_id = h.hint_id AND l.line = p.line)) AS ov,
        CASE WHEN NOT EXISTS (SELECT 1 FROM partial_lines p WHERE p.item = i.item AND p.side = '-') AND NOT EXISTS (SELECT 1 FROM hint_lines l WHERE l.hint_id = h.hint_id) THEN 1 ELSE 0 END AS nw,
        (SELECT count(*) FROM named_paths k WHERE k.session_id = h.session_id AND k.path = h.path AND k.kind = 'checkpoint') AS cp, (SELECT count(*) FROM named_paths k WHERE k.session_id = h.session_id AND k.path = h.path AND k.kind = 'strong') AS st,
        (SELECT count(*) FROM named_paths k WHERE k.session_id = h.session_id AND k.path = h.path AND k.kind = 'weak') AS wk FROM items i JOIN inline_ h ON h.session_id = i.session_id),
    hr AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY ov DESC, nw DESC, cp DESC, st DESC, wk DESC) AS rk FROM sc),
    firm AS (SELECT session_id, min(path) AS path, count(DISTINCT path) AS n FROM known WHERE kind IN ('checkpoint', 'strong') GROUP BY ALL), weak_ AS (SELECT session_id, min(path) AS path, count(DISTINCT path) AS n FROM known WHERE kind = 'weak' GROUP BY ALL),
    rungs AS (SELECT session_id, item, min(path) AS path, 0 AS rung FROM sc GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT session_id, item, min(path), 1 FROM hr WHERE rk = 1 GROUP BY ALL HAVING count(*) = 1 AND max(ov + nw + cp + st) > 0
        UNION ALL SELECT i.session_id, item, path, 2 FROM items i JOIN firm f ON f.session_id = i.session_id AND n = 1 UNION ALL SELECT session_id, item, min(path), 3 FROM sc GROUP BY ALL HAVING count(DISTINCT path) = 1
        UNION ALL SELECT i.session_id, item, path, 4 FROM items i JOIN weak_ f ON f.session_id = i.session_id AND n = 1 WHERE NOT EXISTS (SELECT 1 FROM firm x WHERE x.session_id = i.session_id)),
    low AS (SELECT session_id, item, first(path ORDER BY rung) AS path, min(rung) AS rung FROM rungs GROUP BY ALL), rest AS (SELECT * FROM items ANTI JOIN low USING (session_id, item)),
    near_ AS (SELECT DISTINCT session_id, item, path FROM sc SEMI JOIN rest USING (session_id, item) WHERE ov > 0 OR nw > 0),
    named AS (SELECT * FROM near_ UNION SELECT r.session_id, r.item, a.path FROM rest r JOIN (SELECT session_id, path FROM inline_ UNION SELECT session_id, path FROM known) a ON a.session_id = r.session_id WHERE NOT EXISTS (SELECT 1 FROM near_ n WHERE n.item = r.item)),
    {INDEX}, own AS (SELECT session_id, item, side, line, count(*) AS n FROM partial_lines SEMI JOIN rest USING (session_id, item) WHERE {TELLING} GROUP BY ALL),
    cand AS (SELECT session_id, item, path FROM named UNION SELECT o.session_id, o.item, x.path FROM own o SEMI JOIN named USING (session_id, item) JOIN idx x ON o.line = x.line AND o.side = '+' AND x.repo_root = '/repo/' || (o.session_id % 2)),
    texts AS (SELECT h.session_id, h.path, CAST(h.hint_id AS VARCHAR) AS src, l.line, count(*) AS n FROM hint_rows h JOIN hint_lines l ON l.hint_id = h.hint_id GROUP BY ALL UNION ALL SELECT session_id, path, 'state', line, count(*) FROM (SELECT session_id, path, unnest(string_split(content, chr(10))) AS line FROM original_states) WHERE line <> '' GROUP BY ALL),
    part AS (SELECT c.*, coalesce((SELECT max(s) FROM (SELECT t.src, sum(least(o.n, t.n)) AS s FROM own o JOIN texts t ON t.session_id = o.session_id AND t.line = o.line WHERE o.item = c.item AND o.side = '-' AND t.path = c.path GROUP BY t.src)), 0) AS historical_removed,
        coalesce((SELECT sum(least(o.n, x.n)) FROM own o JOIN idx x ON x.line = o.line WHERE o.item = c.item AND o.side = '+' AND x.path = c.path), 0) AS live_added, coalesce((SELECT sum(least(o.n, x.n)) FROM own o JOIN idx x ON x.line = o.line WHERE o.item = c.item AND o.side = '-' AND x.path = c.path), 0) AS live_removed,
        {", ".join(f"(SELECT count(*) FROM named_paths k WHERE k.session_id = c.session_id AND k.path = c.path AND k.kind = '{k}') AS {n}" for k, n in (("checkpoint", "checkpoint"), ("strong", "strong_hint"), ("weak", "weak_hint")))},
        (SELECT max(CASE WHEN regexp_extract(m.path, '[^/]*$') = regexp_extract(c.path, '[^/]*$') THEN 1 ELSE 0 END) FROM named m WHERE m.item = c.item AND m.path <> c.path) AS b,
        (SELECT max(CASE WHEN regexp_extract(m.path, '^/repo/./[^/]*') = regexp_extract(c.path, '^/repo/./[^/]*') THEN 1 ELSE 0 END) FROM named m WHERE m.item = c.item AND m.path <> c.path) AS p FROM cand c),
    ranks AS (SELECT * EXCLUDE (b, p), coalesce(b, 0) AS basename, coalesce(p, 0) AS proximity FROM part)"""
PICKED = f"""s AS (SELECT *, 100 * historical_removed + 10 * live_added + live_removed AS a, 100 * checkpoint + 10 * strong_hint + 5 * weak_hint + 2 * basename + proximity AS b, ({", ".join(n for n, _ in SCORES)}) AS r FROM ranks),
    o AS (SELECT *, row_number() OVER w AS place, lead(a) OVER w AS na, lead(b) OVER w AS nb, lead(r) OVER w AS nr FROM s WINDOW w AS (PARTITION BY session_id, item ORDER BY {RANKED}, path)),
    sure AS (SELECT session_id, item, path, 5 AS rung FROM o WHERE place = 1 AND a > 0 AND CASE WHEN na IS NULL THEN historical_removed > 0 OR live_added > 0 OR live_removed >= 2 WHEN r = nr THEN false WHEN a > na THEN historical_removed > 0 OR live_added > 0 OR live_removed >= 2
        ELSE a = na AND b > nb AND (historical_removed > 0 OR live_added >= 2 OR live_removed >= 2) END)"""
query("p24_resolved_paths", f"{LADDER}, {PICKED} SELECT * FROM low UNION ALL SELECT * FROM sure", PARTIAL)(lambda read: resolved_partials(read)[0])
query("p24_ambiguous_partials", f"{LADDER}, {PICKED} SELECT session_id, item, 'ambiguous partial diff: ' || count(*) || ' paths are named' AS error FROM named ANTI JOIN sure USING (session_id, item) GROUP BY ALL", PARTIAL)(lambda read: resolved_partials(read)[1])
query("p26_content_index", f"WITH {INDEX} SELECT repo_root, md5(line) AS line_hash, path, n AS count FROM idx", ("repo_files",))(lambda read: path_resolution.content_index(read("repo_files")))

# ---- the commit graph: three lines of commits in each repository, every tenth commit a merge

BEFORE = "OVER (PARTITION BY repo_root ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RELATIONS |= {
    "commit_lines": f"SELECT *, user_id % 3 AS lane, {', '.join(f'max(CASE WHEN user_id % 3 = {n} THEN event_id END) {BEFORE} AS last{n}' for n in range(3))} FROM commits",
    "parent_ids": """SELECT repo_root, event_id, CASE lane WHEN 0 THEN last0 WHEN 1 THEN coalesce(last1, last0) ELSE coalesce(last2, last0) END AS parent_id, 0 AS parent_index FROM commit_lines
        UNION ALL SELECT repo_root, event_id, CASE lane WHEN 0 THEN last1 WHEN 1 THEN last2 ELSE last0 END, 1 FROM commit_lines WHERE event_id % 10 = 0""",
    "commit_parents": f"SELECT repo_root, {SHA.format('event_id')} AS commit_sha, {SHA.format('parent_id')} AS parent_sha, parent_index FROM parent_ids WHERE parent_id IS NOT NULL",
    "branch_tips": f"""SELECT repo_root, CASE user_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'staging' ELSE 'PAC-1_line' END AS branch, {SHA.format('max(event_id)')} AS commit_sha FROM commits GROUP BY repo_root, user_id % 3
        UNION ALL SELECT repo_root, 'AB-' || CAST(event_id AS STRING), commit_sha FROM commits WHERE event_id % 1000 = 7""",
}
NEEDS |= {"commit_lines": ["base", "commits"], "parent_ids": ["base", "commits", "commit_lines"], "commit_parents": ["base", "commits", "commit_lines", "parent_ids"], "branch_tips": ["base", "commits"]}
GRAPH = ("commit_parents", "branch_tips")
CHAINS = "chains AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT repo_root, branch, commit_sha, CAST(0 AS BIGINT) AS distance FROM branch_tips UNION ALL SELECT r.repo_root, r.branch, p.parent_sha, r.distance + 1 FROM r JOIN commit_parents p ON p.repo_root = r.repo_root AND p.commit_sha = r.commit_sha AND p.parent_index = 0) SELECT * FROM r))"
REACHED = "reached AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT repo_root, branch, commit_sha FROM branch_tips UNION SELECT r.repo_root, r.branch, p.parent_sha FROM r JOIN commit_parents p ON p.repo_root = r.repo_root AND p.commit_sha = r.commit_sha) SELECT * FROM r))"
query("w10_first_parent_chains", f"WITH {CHAINS} SELECT * FROM chains", GRAPH)(lambda read: commit_graph.first_parent_chains(read("branch_tips"), read("commit_parents")))
query("src9_branch_commits", f"""WITH {CHAINS}, {REACHED} SELECT e.repo_root, e.branch, e.commit_sha, row_number() OVER (PARTITION BY e.repo_root, e.branch ORDER BY c.commit_time DESC, e.commit_sha) - 1 AS distance, CASE WHEN h.commit_sha IS NULL THEN 0 ELSE 1 END AS on_first_parent
    FROM reached e JOIN commits c ON c.repo_root = e.repo_root AND c.commit_sha = e.commit_sha LEFT JOIN chains h ON h.repo_root = e.repo_root AND h.branch = e.branch AND h.commit_sha = e.commit_sha""", (*GRAPH, "commits"))(
    lambda read: commit_graph.branch_commits(read("branch_tips"), read("commit_parents"), read("commits"))
)
query("w10_owned_commits", f"""WITH {CHAINS} SELECT repo_root, commit_sha, count(*) AS n_owners, min(distance) AS nearest FROM chains c WHERE branch NOT IN ('main', 'staging') AND NOT EXISTS (SELECT 1 FROM chains i WHERE i.branch IN ('main', 'staging') AND i.repo_root = c.repo_root AND i.commit_sha = c.commit_sha) GROUP BY ALL""", GRAPH)(
    lambda read: commit_graph.owners(read("branch_tips"), read("commit_parents"), columns.INTEGRATION_BRANCHES)
)

# ---- code blocks of older sessions

SIDE = lambda lines: f'[{{"modified":[{lines}]}},{{"other":1}}]'
RELATIONS |= {
    "block_targets": f"""SELECT user_id AS session_id, 'f' || {S("event_id % 4")} AS path, CASE WHEN event_id % 3 <> 2 THEN 'd' || {S("event_id")} END AS diff_id, CASE WHEN event_id % 5 <> 0 AND user_id % 3 <> 1 THEN 'a' || chr(10) || {S("event_id % 5")} END AS content,
        CAST(event_id AS INT) AS version, 0 AS idx, event_id FROM base WHERE event_type = 'click' AND (user_id % 2 = 0 OR event_id % 4 = 1)""",
    "block_diffs": f"""SELECT session_id, diff_id, CASE event_id % 9 WHEN 0 THEN '{{"originalModelDiffWrtV0":{SIDE('"x"')},"newModelDiffWrtV0":{SIDE('"y","z"')}}}' WHEN 1 THEN '{{"newModelDiffWrtV0":[]}}' WHEN 3 THEN '{{"originalModelDiffWrtV0":[],"newModelDiffWrtV0":[]}}'
        ELSE '{{"originalModelDiffWrtV0":[],"newModelDiffWrtV0":7}}' END AS value FROM block_targets WHERE diff_id IS NOT NULL AND event_id % 9 <> 6 AND (session_id % 2 = 0 OR event_id % 9 <> 0)""",
    "block_seen": "SELECT DISTINCT session_id, path FROM block_targets WHERE session_id % 7 = 0 AND path = 'f2'",
    "block_totals": "SELECT user_id AS session_id, CAST(max(event_id) % 4 AS BIGINT) AS lines_added, CAST(max(event_id) % 2 AS BIGINT) AS lines_removed FROM base GROUP BY user_id",
    "block_originals": "SELECT DISTINCT session_id, path FROM block_targets WHERE session_id % 5 <> 0",
}
NEEDS |= {"block_targets": ["base"], "block_diffs": ["base", "block_targets"], "block_seen": ["base", "block_targets"], "block_totals": ["base"], "block_originals": ["base", "block_targets"]}
CODE_BLOCKS = ("block_targets", "block_diffs", "block_seen", "block_totals", "block_originals")


def told_blocks(read: Read) -> tuple[DataFrame, DataFrame]:
    return code_blocks.block_changes(read("block_targets").drop("event_id"), *map(read, CODE_BLOCKS[1:]))


TOLD_BLOCKS = """WITH t AS (SELECT t.*, d.value, row_number() OVER w AS seq, last_value(content IGNORE NULLS) OVER (PARTITION BY t.session_id, path ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM block_targets t LEFT JOIN block_diffs d ON d.session_id = t.session_id AND d.diff_id = t.diff_id WINDOW w AS (PARTITION BY t.session_id, path ORDER BY version)),
    k AS (SELECT *, diff_id IS NOT NULL AND value IS NOT NULL AND event_id % 9 = 0 AS own, CASE WHEN diff_id IS NULL THEN NULL WHEN value IS NULL THEN 'the diff of the code block is missing' WHEN event_id % 9 = 1 THEN 'the diff has no list of originalModelDiffWrtV0'
        WHEN event_id % 9 NOT IN (0, 3) THEN 'the diff has no list of newModelDiffWrtV0' END AS error FROM t ANTI JOIN block_seen USING (session_id, path)),
    s AS (SELECT *, CASE WHEN own THEN 'diff' WHEN before <> content THEN 'content' END AS rung, CASE WHEN own THEN 2 ELSE 1 END AS a FROM k),
    l AS (SELECT session_id, path, max(seq) FILTER (rung IS NOT NULL) AS last FROM s GROUP BY ALL), e AS (SELECT s.session_id, s.path, last, first(error ORDER BY seq) AS error FROM s JOIN l USING (session_id, path) WHERE error IS NOT NULL AND rung IS NULL AND (last IS NULL OR seq > last) GROUP BY ALL),
    o AS (SELECT e.session_id, e.path, x.lines_added, x.lines_removed FROM e JOIN block_totals x USING (session_id) SEMI JOIN block_originals USING (session_id, path) WHERE last IS NULL AND (SELECT count(*) FROM e y WHERE y.session_id = e.session_id) = 1 AND lines_added + lines_removed > 0)"""
query("p27_block_changes", f"{TOLD_BLOCKS} SELECT session_id, path, version, idx, rung, a AS lines_added, 1 AS lines_removed FROM s WHERE rung IS NOT NULL UNION ALL SELECT session_id, path, NULL, NULL, 'totals', lines_added, lines_removed FROM o", CODE_BLOCKS)(lambda read: told_blocks(read)[0])
query("p27_block_errors", f"{TOLD_BLOCKS} SELECT session_id, path, error FROM e ANTI JOIN o USING (session_id, path)", CODE_BLOCKS)(lambda read: told_blocks(read)[1])
RELATIONS |= {
    "history_entries": f"SELECT 'f' || {S('user_id % 40')} AS path, event_id AS id, event_id AS timestamp, CASE WHEN event_id % 3 = 0 THEN 'Undo edit' ELSE 'Edit' END AS source, 'a' || chr(10) || {S('event_id % 4')} || chr(10) || 'b' || chr(10) AS content FROM base",
    "wanted_files": f"SELECT user_id AS session_id, 'f' || {S('user_id % 40 + event_id % 2')} AS path, min(event_id) AS begin_ms, max(event_id) AS end_ms FROM base WHERE user_id % 4 <> 0 AND event_type = 'view' GROUP BY user_id, event_id % 2",
    "session_edits": f"SELECT user_id AS session_id, 'g' || {S('event_id % 3')} AS path, count(*) AS lines_added, CAST(0 AS BIGINT) AS lines_removed FROM base WHERE user_id % 3 = 0 AND event_type = 'click' GROUP BY user_id, event_id % 3",
}
NEEDS |= {"history_entries": ["base"], "wanted_files": ["base"], "session_edits": ["base"]}
query("p19_session_lines", """WITH v AS (SELECT *, coalesce(lead(content) OVER (PARTITION BY path ORDER BY timestamp, id), '') AS after FROM history_entries),
    n AS (SELECT w.session_id, w.path, coalesce(sum(CASE WHEN after = '' THEN 0 WHEN after <> content THEN 1 ELSE 0 END) FILTER (v.id IS NOT NULL), 0) AS lines_added, coalesce(sum(CASE WHEN after = '' THEN 3 WHEN after <> content THEN 1 ELSE 0 END) FILTER (v.id IS NOT NULL), 0) AS lines_removed
        FROM wanted_files w LEFT JOIN v ON v.path = w.path AND source = 'Undo edit' AND v.timestamp BETWEEN begin_ms AND end_ms GROUP BY ALL)
    SELECT *, 0 AS stage FROM session_edits UNION ALL SELECT *, 1 FROM n WHERE session_id NOT IN (SELECT session_id FROM session_edits)
    UNION ALL SELECT session_id, '__total__', lines_added, lines_removed, 2 FROM block_totals WHERE lines_added + lines_removed > 0 AND session_id NOT IN (SELECT session_id FROM session_edits) AND session_id NOT IN (SELECT session_id FROM n)""", ("history_entries", "wanted_files", "session_edits", "block_totals"))(
    lambda read: code_blocks.session_lines(read("session_edits"), read("wanted_files"), read("history_entries"), read("block_totals"))
)

# ---- what parsers could not read

N = "chr(10)"
RELATIONS |= {
    "shell_commands": f"""SELECT session_id || '.sh' AS source_file, event_id AS line_no, CASE event_id % 8 WHEN 0 THEN 'cd x && cat > "a b.txt" <<"E F"' || {N} || 'x' || {S("event_id % 4")} || {N} || ' E F' || {N} || 'E F'
        WHEN 1 THEN 'cat > f.txt <<EOF' || {N} || 'never ends' WHEN 2 THEN 'cat > f.txt <<EOF' || {N} || 'y' || {N} || 'EOF' || {N} || 'cat >> g.txt << END' || {N} || 'EOF' || {N} WHEN 3 THEN 'cat >> f.txt <<EOF;' || {N} || 'EOF;' || {N} || 'ls'
        WHEN 4 THEN 'cat > a.txt << ' WHEN 5 THEN 'cat > "a.txt' WHEN 6 THEN 'concat > a <<EOF' || {N} || 'cat a.txt' ELSE 'cat > a <<EOF' || {N} || 'cat > "b' || {N} || 'EOF' || {N} || 'echo; cat > c <<X' || {N} || 'X' END AS cmd FROM base WHERE event_type = 'click'""",
    "broken_diffs": f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '@@ -1 +1 @@' || {N} || '-a' || {N} || '+b' || {N} || 'diff --git a/x b/x' || {N} || '@@ -1 +1 @@' || {N} || '-a' || {N} || '+b' WHEN 1 THEN 'diff --git a/x b/x' || {N} || '--- a/x' || {N} || '+++ b/x' || {N} || '@@ -1,3 +1,2 @@ f()' || {N} || ' a' || {N} || '-b' || {N} || '@@ -9,1 +9,1 @@' || {N} || ' c'
        WHEN 2 THEN 'diff --git a/x b/x' || {N} || '@@ -1,0 +1,2 @@' || {N} || '+b' WHEN 3 THEN 'diff --git a/x b/x' || {N} || 'rename from x' END AS patch FROM base WHERE event_type = 'purchase'""",
}
NEEDS |= {"shell_commands": ["base"], "broken_diffs": ["base"]}
COMMAND = ["source_file", "line_no"]
query("p10_read_documents", f"""SELECT source_file, line_no, x.i AS doc_index, x.m AS mode, x.p AS path, x.c AS content FROM shell_commands, unnest(CASE line_no % 8 WHEN 0 THEN [{{'i': 0, 'm': 'overwrite', 'p': 'a b.txt', 'c': 'x' || (line_no % 4) || {N} || ' E F' || {N}}}]
    WHEN 3 THEN [{{'i': 0, 'm': 'append', 'p': 'f.txt', 'c': ''}}] WHEN 7 THEN [{{'i': 0, 'm': 'overwrite', 'p': 'a', 'c': 'cat > "b' || {N}}}, {{'i': 1, 'm': 'overwrite', 'p': 'c', 'c': ''}}] ELSE [] END) AS u(x)""", ("shell_commands",))(lambda read: dead_letters.written_documents(read("shell_commands"), COMMAND, "cmd")[0])
DOCUMENT_ERROR = "CASE line_no % 8 WHEN 1 THEN 'heredoc terminator ''EOF'' not found' WHEN 2 THEN 'heredoc terminator ''END'' not found' WHEN 4 THEN 'missing heredoc marker' ELSE 'unterminated quoted path in heredoc command' END"
DIFF_ERROR = "CASE event_id % 4 WHEN 0 THEN 'a hunk outside of any file' WHEN 1 THEN 'a hunk says 3 lines and has 2' ELSE 'a hunk says 2 lines and has 1' END"
DIFF_LINE = "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END"
query("snk6_document_errors", f"SELECT source_file, line_no, {DOCUMENT_ERROR} AS error FROM shell_commands WHERE line_no % 8 IN (1, 2, 4, 5)", ("shell_commands",))(lambda read: dead_letters.written_documents(read("shell_commands"), COMMAND, "cmd")[1])
query("snk6_diff_errors", f"SELECT event_id, {DIFF_LINE} AS line_no, {DIFF_ERROR} AS error FROM broken_diffs WHERE event_id % 4 <> 3", ("broken_diffs",))(lambda read: dead_letters.diff_errors(read("broken_diffs"), ["event_id"], "patch"))


def all_letters(read: Read) -> DataFrame:
    return dead_letters.dead_letters(
        dead_letters.record_errors(read("claude_log"), "claude log"),
        dead_letters.record_errors(read("codex_log"), "codex log"),
        dead_letters.letters(patched(read)[2], "patch"),
        dead_letters.letters(dead_letters.written_documents(read("shell_commands"), COMMAND, "cmd")[1], "here-document"),
        dead_letters.letters(dead_letters.diff_errors(read("broken_diffs").withColumn("source_file", F.col("event_id").cast("string")), ["source_file"], "patch"), "diff"),
    )


query("snk6_dead_letters", f"""{C}, d AS (SELECT source_file, CAST(3 * place AS BIGINT) AS line_no, 'claude log' AS parser, 'the line is no JSON' AS error FROM c WHERE event_type = 'view' AND event_id % 2 = 1
    UNION ALL SELECT source_file, line_no, 'here-document', {DOCUMENT_ERROR} FROM shell_commands WHERE line_no % 8 IN (1, 2, 4, 5) UNION ALL SELECT CAST(event_id AS VARCHAR), {DIFF_LINE}, 'diff', {DIFF_ERROR} FROM broken_diffs WHERE event_id % 4 <> 3)
    SELECT source_file, line_no, CAST(NULL AS VARCHAR) AS call_id, parser, error FROM d""", ("claude_log", "codex_log", "shell_commands", "broken_diffs"))(all_letters)

# ---- places of paths, local histories, small rules

RELATIONS |= {
    "logged_paths": f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/repo/1/src/../lib/f.py' WHEN 1 THEN ' "src//a b.py" ' WHEN 2 THEN 'C:' || chr(92) || 'Work' || chr(92) || 'x.py' WHEN 3 THEN './g.py' WHEN 4 THEN 'file:///repo/2/a%20b.py' ELSE '/elsewhere/f.py' END AS path,
        CASE WHEN event_id % 2 = 0 THEN NULL ELSE '/repo/' || {S("user_id % 3")} || '/' END AS workdir, '/repo/' || {S("user_id % 3")} || '/sub' AS cwd FROM base""",
    "root_list": "SELECT DISTINCT repo_root FROM base WHERE repo_root IS NOT NULL UNION ALL SELECT 'c:/Work' UNION ALL SELECT '/repo/2/nested'",
    "entries_json": f"""SELECT {S("user_id")} AS folder, '{{"version":1,' || CASE WHEN user_id % 5 = 0 THEN '' ELSE '"resource":"file:///r/f' || {S("user_id % 9")} || '%20x.py",' END || '"entries":[{{"id":"a' || {S("min(event_id)")} || '","source":"Undo","timestamp":' || {S("min(event_id)")} || '}},{{"id":"b"}},{{"timestamp":3}}]}}' AS value FROM base GROUP BY user_id""",
    "hosted_pulls": f"SELECT 'k' || {S('user_id % 3')} AS repo_key, event_id AS pr_number, CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, ts AS last_checked_at FROM base WHERE event_type = 'click'",
}
NEEDS |= {"logged_paths": ["base"], "root_list": ["base"], "entries_json": ["base"], "hosted_pulls": ["base"]}
query("p28_located_paths", """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/repo/1/lib/f.py' WHEN 1 THEN rtrim(workdir, '/') || '/src/a b.py' WHEN 2 THEN 'c:/Work/x.py' WHEN 3 THEN rtrim(workdir, '/') || '/g.py' WHEN 4 THEN '/repo/2/a b.py' ELSE path END AS abs_path FROM logged_paths),
    b AS (SELECT a.*, (SELECT max(repo_root) FROM root_list r WHERE starts_with(a.abs_path, r.repo_root || '/')) AS repo_root FROM a) SELECT *, substr(abs_path, length(repo_root) + 2) AS rel_path FROM b""", ("logged_paths", "root_list"))(
    lambda read: places.located(read("logged_paths"), read("root_list")).select("event_id", "abs_path", "repo_root", "rel_path")
)
query("src7_history_entries", """SELECT folder, '/r/f' || (CAST(folder AS BIGINT) % 9) || ' x.py' AS path, x.i AS id, x.s AS source, x.t AS timestamp FROM (SELECT folder, regexp_extract(value, '"id":"a([0-9]+)"', 1) AS n FROM entries_json WHERE CAST(folder AS BIGINT) % 5 <> 0),
    unnest([{'i': 'a' || n, 's': 'Undo', 't': CAST(n AS BIGINT)}, {'i': 'b', 's': '', 't': 0}]) AS u(x)""", ("entries_json",))(lambda read: places.history_entries(read("entries_json")))
query("i5_pulls_to_refresh", "SELECT repo_key, pr_number FROM hosted_pulls WHERE state = 'open' AND last_checked_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR", ("hosted_pulls",))(lambda read: incremental.pulls_to_refresh(read("hosted_pulls"), "2024-01-15 12:00:00").select("repo_key", "pr_number"))
query("x21_task_parts", """SELECT branch, k, CASE WHEN regexp_matches(k, '^[A-Z]+-[0-9]+$') THEN string_split(k, '-')[1] END AS prefix, CASE WHEN regexp_matches(k, '^[A-Z]+-[0-9]+$') THEN CAST(string_split(k, '-')[2] AS BIGINT) END AS number
    FROM (SELECT DISTINCT branch, CASE WHEN event_id % 2 = 0 THEN 'AB-' || (event_id % 50) WHEN event_id % 3 = 0 THEN 'x-' || event_id % 7 ELSE branch END AS k FROM base)""", ("base",))(
    lambda read: read("base").select("branch", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("AB-"), F.col("event_id") % 50)).when(F.col("event_id") % 3 == 0, F.concat(F.lit("x-"), F.col("event_id") % 7)).otherwise(F.col("branch")).alias("k")).distinct().withColumns({"prefix": columns.task_prefix(F.col("k")), "number": columns.task_number(F.col("k"))})
)
query("x22_integration_branches", "SELECT b, b IN ('main', 'master', 'staging', 'develop') OR starts_with(b, 'release/') AS integration FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'release/' || (event_id % 9) ELSE branch END AS b FROM base)", ("base",))(
    lambda read: read("base").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("release/"), F.col("event_id") % 9)).otherwise(F.col("branch")).alias("b")).distinct().withColumn("integration", columns.is_metadata_integration(F.col("b")))
)
query("src16_repository_keys", """SELECT DISTINCT event_id % 60 AS k, CASE event_id % 5 WHEN 3 THEN NULL ELSE 'git:github.com/Acme/r' || (event_id % 12) END AS repo_key FROM base""", ("base",))(
    lambda read: read("base").select((F.col("event_id") % 60).alias("k"), columns.repo_key(F.concat(F.element_at(F.array(*map(F.lit, ("git@GitHub.com:Acme/r", "https://u:p@github.com/Acme/r", "ssh://git@github.com/Acme/r", "nowhere", " https://github.com/Acme/r"))), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_id") % 12, F.lit(".git/"))).alias("repo_key")).withColumn("repo_key", F.when(F.col("k") % 5 != 3, F.col("repo_key"))).distinct()
)
query("h4_line_totals", "SELECT repo_root, commit_sha, CAST(sum(count) AS BIGINT) AS total FROM commit_hashes GROUP BY ALL", ("commit_hashes",))(lambda read: hashing.total(read("commit_hashes"), ["repo_root", "commit_sha"]))
query("h7_most_of_each_line", "SELECT repo_root, rel_path, line_hash, max(count) AS count FROM change_hashes GROUP BY ALL", ("change_hashes",))(lambda read: hashing.max_merge(read("change_hashes"), ["repo_root", "rel_path", "line_hash"]))
RELATIONS["model_texts"] = f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{{"a":{{"model":"gpt-1"}},"model":"claude-' || {S("event_id % 5")} || '"}}' WHEN 1 THEN '{{"model":{{"slug":"x","name":" gpt-4' || {S("event_id % 3")} || ' "}}}}' WHEN 2 THEN '[{{"b":[{{"chatModel":"o1-b"}}]}},{{"a":1,"model":"o3"}}]'
    WHEN 3 THEN '{{"z":{{"model":"default"}},"b":{{"defaultModel":"other"}}}}' WHEN 4 THEN '{{"usageData":{{"Default":{{}},"zz-opus":{{}}}},"model":"gpt-9"}}' WHEN 5 THEN '{{"model":"none","b":{{"modelName":"haiku-b"}},"a":[{{"currentModel":{{"id":{{"name":"qwen"}}}}}}]}}' WHEN 6 THEN '{{"model":4,"x":"gpt"}}' ELSE 'no {{json' END AS value FROM base"""
NEEDS["model_texts"] = ["base"]
query("p17_models_by_object", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'claude-' || (event_id % 5) WHEN 1 THEN 'gpt-4' || (event_id % 3) WHEN 2 THEN 'o1-b' WHEN 3 THEN 'default' WHEN 4 THEN 'zz-opus' WHEN 5 THEN 'qwen' END AS model_name FROM base", ("base",))(lambda read: model_names.model_names(read("model_texts"), ["event_id"], "value"))
query("p21_cascade", """WITH t AS (SELECT session_id, path, lines_added, lines_removed FROM session_edits), i AS (SELECT session_id, path, count(*) AS lines_added, CAST(0 AS BIGINT) AS lines_removed FROM hint_rows GROUP BY ALL), p AS (SELECT session_id, path, CAST(1 AS BIGINT) AS a, CAST(2 AS BIGINT) AS r FROM wanted_files), l AS (SELECT DISTINCT session_id, path, CAST(3 AS BIGINT) AS a, CAST(0 AS BIGINT) AS r FROM block_targets)
    SELECT *, 0 AS stage FROM t UNION ALL SELECT *, 1 FROM i ANTI JOIN t USING (session_id, path) UNION ALL SELECT *, 2 FROM p ANTI JOIN t USING (session_id, path) ANTI JOIN i USING (session_id, path) UNION ALL SELECT *, 3 FROM l ANTI JOIN t USING (session_id, path) ANTI JOIN i USING (session_id, path) ANTI JOIN p USING (session_id, path)""",
      ("session_edits", "hint_rows", "wanted_files", "block_targets"))(
    lambda read: (lambda edits, *more: store_changes.cascade(edits, *more))(
        read("session_edits"),
        read("hint_rows").groupBy("session_id", "path").agg(F.count("*").alias("lines_added"), F.lit(0).cast("bigint").alias("lines_removed")),
        read("wanted_files").select("session_id", "path", F.lit(1).cast("bigint").alias("lines_added"), F.lit(2).cast("bigint").alias("lines_removed")),
        read("block_targets").select("session_id", "path", F.lit(3).cast("bigint").alias("lines_added"), F.lit(0).cast("bigint").alias("lines_removed")).distinct(),
    )
)


def logs_as_files(read: Read) -> tuple[SparkSession, str]:
    """A folder with the logs of each provider and week as one file of lines."""
    week = F.regexp_extract("source_file", "([0-9]{4}-[0-9]{2}-[0-9]{2}).jsonl$", 1)
    logs = read("claude_log").withColumn("provider", F.lit("claude")).unionByName(read("codex_log").withColumn("provider", F.lit("codex"))).withColumn("week", week)
    folder = tables.new_table(logs.sparkSession)
    sorted_ = logs.repartition("provider", "week").sortWithinPartitions("provider", "week", "source_file", "line_no")
    sorted_.select("provider", "week", "value").write.partitionBy("provider", "week").text(folder)
    return logs.sparkSession, folder


def log_name() -> list[Column]:
    return [F.regexp_extract("source_file", "provider=([a-z]+)/week=([-0-9]+)/", k).alias(name) for k, name in ((1, "provider"), (2, "week"))]


BOTH = "WITH l AS (SELECT 'claude' AS provider, source_file, line_no, value FROM claude_log UNION ALL SELECT 'codex', source_file, line_no, value FROM codex_log), w AS (SELECT *, regexp_extract(source_file, '([0-9]{4}-[0-9]{2}-[0-9]{2}).jsonl$', 1) AS week FROM l)"


@query("src1_log_files", f"{BOTH} SELECT provider, week, CAST(sum(strlen(value) + 1) AS BIGINT) AS size FROM w GROUP BY provider, week", ("claude_log", "codex_log"))
def _(read: Read) -> DataFrame:
    found = files.log_files(*logs_as_files(read), pattern="*.txt")
    return found.select(*log_name(), "size")


@query("src2_log_lines", f"{BOTH} SELECT provider, week, row_number() OVER (PARTITION BY provider, week ORDER BY source_file, line_no) - 1 AS line_no, md5(value) AS line FROM w", ("claude_log", "codex_log"))
def _(read: Read) -> DataFrame:
    lines = files.log_lines(*logs_as_files(read), pattern="*.txt")
    return lines.select(*log_name(), "line_no", F.md5("value").alias("line"))


@query("src17_identities", """WITH e AS (SELECT repo_root, 'dev' || max(user_id) || '@acme.org' AS email FROM base WHERE repo_root <> '/repo/1' GROUP BY repo_root)
    SELECT s.provider, s.session_id, coalesce(e.email, 'all@acme.org') AS member_email,
        'device:' || md5(CASE WHEN s.provider = 'claude' THEN '(unknown-host)' ELSE s.provider END || chr(10) || CASE WHEN s.provider = 'codex' THEN '(unknown-home)' ELSE '/home/' || s.session_id END) AS device_id
    FROM sessions AS s LEFT JOIN e ON e.repo_root = s.project_path""", ("base", "sessions"))  # fmt: skip
def _(read: Read) -> DataFrame:
    emails = read("base").filter("repo_root <> '/repo/1'").groupBy("repo_root").agg(F.concat(F.lit("dev"), F.max("user_id"), F.lit("@acme.org")).alias("email"))
    told = identity.with_member(read("sessions").drop("repo_root"), emails, "all@acme.org", "project_path")
    host, home = F.when(F.col("provider") == "claude", " ").otherwise(F.col("provider")), F.when(F.col("provider") != "codex", F.concat(F.lit("/home/"), "session_id"))
    return told.select("provider", "session_id", "member_email", identity.device_id(host, home).alias("device_id"))
