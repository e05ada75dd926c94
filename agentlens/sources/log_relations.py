"""Session logs and stores derived from the tables at hand, as texts that the parsers read.

As in `adapter`, each relation is SQL that Spark and other engines read alike.
"""

from __future__ import annotations

import re

from agentlens.sources.adapter import NEEDS, RELATIONS, SHA


def text(template: str) -> str:
    """SQL for a text: `[[...]]` is an expression in it and `~` a line end within JSON."""
    parts = re.split(r"\[\[(.*?)\]\]", template.replace("~", "[[chr(92) || 'n']]"))
    return " || ".join(f"coalesce(CAST({p} AS STRING), '')" if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts) if p)


AT = "CAST(date_trunc('second', ts) AS STRING)"
FILE_NO = "CAST(event_id % 6 AS STRING)"
CLAUDE = {  # event types to records: a place within the event, a condition and the record
    "signup": [(0, "true", '{"type":"user","timestamp":"[[@at]]Z","sessionId":"[[session_id]]","cwd":"[[repo_root]]","message":{"content":"Please sort  column [[event_id % 9]]"}}')],
    "view": [(0, "event_id % 2 = 0", '{"type":"user","isMeta":true,"timestamp":"[[@at]]Z","message":{"content":"not said"}}'), (0, "event_id % 2 = 1", "no record")],
    "error": [(0, "true", '{"type":"user","timestamp":"[[@at]]Z","message":{"content":"<command-name>/clear"}}')],
    "click": [
        (0, "true", '{"type":"assistant","timestamp":"[[@at]]Z","message":{"model":"m[[event_id % 3]]","content":[{"type":"text","text":"done"},{"type":"tool_use","id":"t[[event_id]]","name":"Edit","input":{"file_path":"/r/f[[@file]].py"}}]}}'),
        (1, "event_id % 11 <> 0", '{"type":"user","timestamp":"[[@at]]Z","message":{"content":[{"type":"tool_result","tool_use_id":"t[[event_id]]","is_error":[[CASE WHEN event_id % 5 = 0 THEN \'true\' ELSE \'false\' END]]}]},"toolUseResult":{"filePath":"/r/f[[@file]].py","oldString":"a~b~","newString":"a~c[[event_id % 4]]  ~d~"}}'),
    ],
    "purchase": [
        (0, "true", '{"type":"assistant","timestamp":"[[@at]]Z","message":{"model":"[[CASE WHEN event_id % 2 = 0 THEN \'<synthetic>\' ELSE \'n1\' END]]","content":[{"type":"text","text":"one"},{"type":"text","text":"two"},{"type":"tool_use","id":"w[[event_id]]","name":"Write","input":{}}]}}'),
        (1, "true", '{"type":"user","timestamp":"[[@at]]Z","message":{"content":[{"type":"tool_result","toolUseId":"w[[event_id]]"}]},"toolUseResult":{"filePath":"[[CASE WHEN event_id % 7 = 0 THEN \'/x/.claude/plans/p.md\' ELSE \'/r/g.py\' END]]","type":"update","content":"z","structuredPatch":[{"lines":[" x","-y","+z[[event_id % 4]]","+z[[event_id % 4]]"]},{"lines":["-q"]}]}}'),
    ],
}
CODEX = {
    "view": [(0, "true", '{"type":"turn_context","timestamp":"[[@at]]Z","payload":{"model":"m[[event_id % 3]]"}}')],
    "signup": [(0, "true", '{"type":"event_msg","timestamp":"[[@at]]Z","payload":{"type":"user_message","message":"[[CASE WHEN event_id % 3 = 0 THEN \' \' ELSE \'do it again\' END]]"}}')],
    "purchase": [(0, "true", '{"type":"response_item","timestamp":"[[@at]]Z","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"a[[event_id % 2]]"},{"type":"other","text":"-"},{"type":"output_text","text":" b"}]}}')],
    "click": [
        (0, "true", '{"type":"response_item","timestamp":"[[@at]]Z","payload":{"type":"custom_tool_call","call_id":"p[[event_id]]","name":"apply_patch","input":"*** Begin Patch~*** Update File: a[[@file]].py~@@~-old~+new[[event_id % 4]]~+more~*** Update File: m.py~*** Move to: n.py~*** Add File: b.py~+b~*** End Patch~+no"}}'),
        (1, "true", '{"type":"response_item","timestamp":"[[@at]]Z","payload":{"type":"custom_tool_call_output","call_id":"p[[event_id]]","output":"{[[@q]]metadata[[@q]]:{[[@q]]exit_code[[@q]]:[[event_id % 3]]}}"}}'),
    ],
    "error": [
        (0, "true", '{"type":"response_item","timestamp":"[[@at]]Z","payload":{"type":"function_call","call_id":"x[[event_id]]","name":"[[CASE WHEN event_id % 7 = 0 THEN \'read_file\' ELSE \'exec_command\' END]]","arguments":"{[[@q]]cmd[[@q]]:[[@q]]cat > f.txt <<EOF[[@n]]x[[event_id % 4]][[@n]]y[[@n]]EOF[[@n]]cat >> f.txt <<EOF[[@n]]z[[@n]]EOF[[@q]],[[@q]]workdir[[@q]]:[[@q]]/w[[@q]]}"}}'),
        (1, "true", '{"type":"response_item","timestamp":"[[@at]]Z","payload":{"type":"function_call_output","call_id":"x[[event_id]]","output":"Process exited with code [[event_id % 2]]"}}'),
    ],
}
MARKS = {"@at": AT, "@file": FILE_NO, "@q": "chr(92) || chr(34)", "@n": "chr(92) || chr(92) || 'n'"}


def marked(template: str) -> str:
    for name, sql in MARKS.items():
        template = template.replace(f"[[{name}]]", f"[[{sql}]]").replace(f"{name} ", f"{sql} ")
    return template


def log_lines(provider: str, kinds: dict, first: int) -> str:
    """(source_file, line_no, value) of all sessions of a provider; events take three lines each."""
    each = [
        f"SELECT session_id || '.jsonl' AS source_file, CAST({first} + 3 * place + {k} AS BIGINT) AS line_no, {text(marked(record))} AS value FROM placed_{provider} WHERE event_type = '{kind}' AND {test}"
        for kind, records in kinds.items()
        for k, test, record in records
    ]
    return " UNION ALL ".join(each)


def placed(provider: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS place FROM base WHERE provider = '{provider}'"


STORE = [
    ("signup", '"bubbleId:" || session_id || ":b" || event_id', '{"type":1,"createdAt":[[1000 * event_id]],"text":"[[CASE WHEN event_id % 4 = 0 THEN \'\' ELSE \'please  go on\' END]]"}'),
    ("view", '"bubbleId:" || session_id || ":b" || event_id', '{"type":2,"createdAt":[[1000 * event_id]],"text":"sure","modelInfo":{"modelName":"m[[event_id % 3]]"}}'),
    ("click", '"bubbleId:" || session_id || ":b" || event_id',
     '{"type":2,"text":"","toolFormerData":{"name":"[[CASE WHEN event_id % 5 = 0 THEN \'read_file\' ELSE \'edit_file_v2\' END]]","status":"[[CASE WHEN event_id % 3 = 0 THEN \'error\' ELSE \'completed\' END]]","params":"{[[CASE event_id % 7 WHEN 1 THEN @q || \'paths\' || @q || \':[\' || @q ELSE @q || \'path\' || @q || \':\' || @q END]]/r/f[[@file]].py[[CASE event_id % 7 WHEN 1 THEN @q || \']\' WHEN 2 THEN @q || \',\' || @q || \'targetFile\' || @q || \':\' || @q || \'/r/other.py\' || @q ELSE @q END]]}","result":"{[[@q]]diffs[[@q]]:[{[[@q]]diffString[[@q]]:[[@q]]+a[[@n]]-b[[@n]]+c[[@n]] d[[@q]]}]}"}}'),
    ("error", '"codeBlockPartialInlineDiffFates:" || session_id || ":" || event_id', '{"path":"/r/p[[event_id % 4]]","fates":[{"fate":"accepted","line":"q[[event_id % 2]]"},{"fate":"[[CASE WHEN event_id % 3 = 0 THEN \'accepted\' ELSE \'rejected\' END]]","line":"w"}]}'),
    ("purchase", '"unknownKind:" || session_id || ":" || event_id', "{}"),
]


def store_rows() -> str:
    """(key, value): a head for each session, and what its events leave."""
    each = [f"SELECT {key.replace(chr(34), chr(39))} AS key, {text(marked(value))} AS value FROM base WHERE provider = 'cursor' AND event_type = '{kind}'" for kind, key, value in STORE]
    head = text('{"composerId":"[[session_id]]","createdAt":[[1000 * min(event_id)]],"modelConfig":{"modelName":"[[max(CASE WHEN event_type = \'click\' THEN \'named\' END)]]"},"fullConversationHeadersOnly":[{"bubbleId":"b[[max(event_id)]]","type":1},{"bubbleId":"b[[min(event_id)]]","type":2}]}')
    return " UNION ALL ".join([*each, f"SELECT 'composerData:' || session_id AS key, {head} AS value FROM base WHERE provider = 'cursor' GROUP BY session_id"])


DIFF = """diff --git a/src/f[[@file]].py b/src/f[[@file]].py[[chr(10)]]--- a/src/f[[@file]].py[[chr(10)]]+++ b/src/f[[@file]].py[[chr(10)]]@@ -1 +1,2 @@[[chr(10)]]-a[[chr(10)]]+b[[event_id % 4]] [[chr(10)]]+b[[event_id % 4]][[chr(10)]]diff --git a/o.py b/n.py[[chr(10)]]rename from o.py[[chr(10)]]rename to n.py[[chr(10)]]diff --git a/d.py b/d.py[[chr(10)]]deleted file mode 100644[[chr(10)]]--- a/d.py[[chr(10)]]+++ /dev/null[[chr(10)]]-gone[[chr(10)]]"""
LOGS = {
    "placed_claude": placed("claude"),
    "claude_log": log_lines("claude", CLAUDE, 0),
    "placed_codex": placed("codex"),
    "codex_log": f"""SELECT session_id || '.jsonl' AS source_file, CAST(0 AS BIGINT) AS line_no, {text(marked('{"type":"session_meta","timestamp":"[[CAST(date_trunc(@sec, min(ts)) AS STRING)]]Z","payload":{"id":"[[session_id]]","cwd":"/w"}}')).replace("@sec", "'second'")} AS value FROM placed_codex GROUP BY session_id
        UNION ALL {log_lines("codex", CODEX, 1)}""",
    "store_rows": store_rows(),
    "diff_texts": f"SELECT {SHA.format('event_id')} AS commit_sha, event_id, {text(marked(DIFF))} AS patch FROM base WHERE event_type = 'purchase'",
    "pull_files": """SELECT 'k' || CAST(user_id % 3 AS STRING) AS repo_key, event_id AS pr_number, 'a.py' AS filename, CASE WHEN event_id % 3 = 0 THEN 'old.py' END AS previous_filename, CASE event_id % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'modified' ELSE 'added' END AS status,
        CASE WHEN event_id % 4 <> 0 THEN '@@' || chr(10) || '-x' || CAST(event_id % 5 AS STRING) || chr(10) || '-same ' || chr(10) || '+y' || chr(10) || '--- z' END AS patch FROM base WHERE event_type = 'click'""",
    "issues": "SELECT 'k' || CAST(user_id % 3 AS STRING) AS repo_key, event_id AS issue_number, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS bug_candidate_flag, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS is_pull_request_flag FROM base WHERE event_type = 'click'",
    "issue_timeline": """SELECT 'k' || CAST(user_id % 3 AS STRING) AS repo_key, event_id AS issue_number, event_id AS pr_number, 1 AS position, CASE WHEN event_id % 2 = 0 THEN ts END AS linked_at FROM base WHERE event_type = 'click'
        UNION ALL SELECT 'k' || CAST(user_id % 3 AS STRING), event_id, event_id, 2, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 DAY END FROM base WHERE event_type = 'click'""",
    "pulls_of_commit": f"SELECT 'k' || CAST(user_id % 3 AS STRING) AS repo_key, {SHA.format('(event_id - event_id % 4)')} AS commit_sha, event_id AS pr_number, CASE WHEN event_id % 4 <> 0 THEN ts END AS created_at FROM base",
    "source_files": "SELECT session_id || '.jsonl' AS path, max(event_id) AS mtime, count(*) AS size FROM base GROUP BY session_id",
    "file_cursors": "SELECT CASE WHEN max(event_id) % 3 = 0 THEN 'p2' ELSE 'p1' END AS provider, session_id || '.jsonl' AS source_file, max(event_id) AS file_mtime, CASE WHEN max(event_id) % 5 = 0 THEN count(*) - 1 ELSE count(*) END AS file_size FROM base GROUP BY session_id",
}
RELATIONS.update(LOGS)
NEEDS.update({name: ["base"] for name in LOGS} | {"claude_log": ["base", "placed_claude"], "codex_log": ["base", "placed_codex"]})
