import json

from pyspark.sql import functions as F

from agentlens.sources import claude_logs, codex_logs, files, kv_store, patches, store_changes
from agentlens.streaming import ingest


def lines(spark, tmp_path, name, records):
    (tmp_path / "p").mkdir(exist_ok=True)
    (tmp_path / "p" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return files.log_lines(spark, str(tmp_path)).filter(F.endswith("source_file", F.lit(name)))


def test_first_log_kind(spark, tmp_path):
    text = lambda t: {"type": "text", "text": t}
    edit = {"filePath": "/r/a.py", "oldString": "a\nb", "newString": "a\nc\nd"}
    patch = {"filePath": "/r/b.py", "type": "update", "content": "z", "structuredPatch": [{"lines": [" x", "-y", "+z", "+z"]}]}
    records = [
        {"type": "user", "timestamp": "2026-03-01T00:00:00Z", "cwd": "/r", "sessionId": "S", "message": {"content": "please fix"}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}}, "not json", {"type": "user", "message": {"content": "<command-name>/clear"}},
        {"type": "assistant", "timestamp": "2026-03-01T00:01:00Z", "message": {"model": "m1", "content": [text("one"), text("two"), {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/r/a.py"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1"}]}, "toolUseResult": edit},
        {"type": "assistant", "message": {"model": "<synthetic>", "content": [{"type": "tool_use", "id": "t2", "name": "Write", "input": {}}, {"type": "tool_use", "id": "t3", "name": "Edit", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t2"}]}, "toolUseResult": patch},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t3", "is_error": True}]}, "toolUseResult": edit},
    ]
    rows = claude_logs.records(lines(spark, tmp_path, "x.jsonl", records))
    (s,) = claude_logs.sessions(rows).collect()
    assert (s["session_id"], s["cwd"], s["model_name"]) == ("S", "/r", "m1")
    said = claude_logs.messages(rows).orderBy("message_index").collect()
    assert [(m["role"], m["content"], m["content_words"]) for m in said] == [("user", "please fix", 2), ("assistant", "one\ntwo", 2)]
    ops, hashes = claude_logs.writes(claude_logs.tool_calls(rows))
    assert sorted((r["path"], r["mode"], r["lines_added"], r["lines_removed"]) for r in ops.collect()) == [("/r/a.py", "patch", 2, 1), ("/r/b.py", "patch", 2, 1)]
    assert {(r["path"], r["side"], r["count"]) for r in hashes.filter("path = '/r/b.py'").collect()} == {("/r/b.py", "+", 2), ("/r/b.py", "-", 1)}


def test_second_log_kind(spark, tmp_path):
    call = lambda k, **x: {"type": "response_item", "timestamp": "2026-03-01T00:02:00Z", "payload": {"type": k, **x}}
    records = [
        {"type": "session_meta", "timestamp": "2026-03-01T00:00:00Z", "payload": {"id": "S2", "cwd": "/w"}},
        {"type": "turn_context", "payload": {"model": "m"}}, {"type": "turn_context", "payload": {"model": "later"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "do it"}},
        call("message", role="assistant", content=[{"type": "output_text", "text": "a"}, {"type": "other", "text": "-"}, {"type": "output_text", "text": "b"}]),
        call("function_call", call_id="1", name="exec_command", arguments=json.dumps({"cmd": "cat > f.txt <<'EOF'\nx\ny\nEOF\ncat >> f.txt <<EOF\nz\nEOF", "workdir": "/w"})), call("function_call_output", call_id="1", output="Process exited with code 0"),
        call("custom_tool_call", call_id="2", name="apply_patch", input="*** Begin Patch\n*** Update File: a.py\n@@\n-old\n+new\n+more\n*** Add File: b.py\n+b\n*** End Patch\n+no"), call("custom_tool_call_output", call_id="2", output=json.dumps({"metadata": {"exit_code": 0}})),
        call("custom_tool_call", call_id="3", name="apply_patch", input="*** Begin Patch"), call("custom_tool_call_output", call_id="3", output=json.dumps({"metadata": {"exit_code": 1}})),
    ]
    rows = codex_logs.records(lines(spark, tmp_path, "y.jsonl", records))
    (s,) = codex_logs.sessions(rows).collect()
    assert (s["session_id"], s["cwd"], s["model_name"]) == ("S2", "/w", "m")
    assert [(m["role"], m["content"]) for m in codex_logs.messages(rows).orderBy("message_index").collect()] == [("user", "do it"), ("assistant", "ab")]
    calls = codex_logs.tool_calls(rows)
    assert sorted(r["call_id"] for r in calls.collect()) == ["1", "2"]
    ops, hashes, errors = patches.apply_patch(calls.filter("name = 'apply_patch'"), ["call_id"], "input")
    assert sorted((r["op_index"], r["path"], r["added_lines"], r["removed_lines"]) for r in ops.collect()) == [(0, "a.py", 2, 1), (1, "b.py", 1, 0)]
    assert errors.count() == 0 and hashes.count() == 4
    docs = patches.heredocs(codex_logs.commands(calls), ["source_file", "line_no"], "cmd")
    assert [(r["doc_index"], r["mode"], r["path"], r["content"]) for r in docs.orderBy("doc_index").collect()] == [(0, "overwrite", "f.txt", "x\ny\n"), (1, "append", "f.txt", "z\n")]


def test_heredoc_states(spark):
    docs = spark.createDataFrame([("s", 1, "append", "f", "0"), ("s", 2, "overwrite", "f", "a"), ("s", 3, "append", "f", "b"), ("s", 4, "append", "f", "c"), ("s", 5, "overwrite", "f", "d"), ("s", 6, "overwrite", "g", "e")], "session string, at int, mode string, path string, content string")
    got = {r["at"]: r["before"] for r in patches.heredoc_changes(docs, ["session"], ["at"]).collect()}
    assert got == {1: None, 2: None, 3: "a", 4: "ab", 5: "abc", 6: None}


def test_unreadable_patches(spark):
    calls = spark.createDataFrame([(1, "nonsense"), (2, "*** Begin Patch\n*** End Patch"), (3, json.dumps({"patch": "*** Add File: x\n+y"})), (4, None)], "id int, input string")
    ops, _, errors = patches.apply_patch(calls, ["id"], "input")
    assert [(r["id"], r["path"]) for r in ops.collect()] == [(3, "x")] and sorted(r["id"] for r in errors.collect()) == [1, 2, 4]


def test_unified_diff(spark):
    text = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+b\ndiff --git a/o.py b/n.py\nsimilarity index 90%\nrename from o.py\nrename to n.py\ndiff --git a/d.py b/d.py\ndeleted file mode 100644\n--- a/d.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\ndiff --git a/e.py b/e.py\nnew file mode 100644\n--- /dev/null\n+++ b/e.py\n@@ -0,0 +1 @@\n+new\n"
    rows = spark.createDataFrame([("c", text), ("empty", "")], "sha string, patch string")
    files_, hashes = patches.unified_diff(rows, ["sha"], "patch")
    assert sorted((r["rel_path"], r["change_type"], r["added_lines"], r["removed_lines"]) for r in files_.collect()) == [("d.py", "delete", 0, 1), ("e.py", "add", 1, 0), ("n.py", "rename", 0, 0), ("x.py", "modify", 2, 1)]
    assert {(r["rel_path"], r["side"], r["count"]) for r in hashes.collect()} == {("d.py", "-", 1), ("e.py", "+", 1), ("x.py", "+", 2), ("x.py", "-", 1)}


def test_key_value_store(spark):
    diff = json.dumps({"diffs": [{"diffString": "+a\n-b\n+c"}]})
    bubble = lambda **x: json.dumps(x)
    rows = kv_store.entries(spark.createDataFrame([
        ("composerData:S", json.dumps({"composerId": "S", "createdAt": 1000, "fullConversationHeadersOnly": [{"bubbleId": "b2", "type": 1}, {"bubbleId": "b1", "type": 2}]})),
        ("bubbleId:S:b1", bubble(type=2, text="sure thing", toolFormerData={"name": "edit_file_v2", "status": "completed", "params": json.dumps({"path": "/r/x"}), "result": diff})),
        ("bubbleId:S:b2", bubble(type=1, text="please")), ("other", "x"),
        ("codeBlockPartialInlineDiffFates:S:1", json.dumps({"path": "/r/y", "fates": [{"fate": "accepted", "line": "q"}, {"fate": "rejected", "line": "w"}]})),
    ], "key string, value string"))
    assert [(m["role"], m["content"]) for m in kv_store.messages(rows).orderBy("message_index").collect()] == [("user", "please"), ("assistant", "sure thing")]
    edits = kv_store.tool_edits(rows)
    assert [(r["path"], r["lines_added"], r["lines_removed"]) for r in edits.collect()] == [("/r/x", 2, 1)]
    fates = kv_store.accepted_fates(rows).select("session_id", "path", F.size("added").cast("bigint").alias("lines_added"), F.lit(0).cast("bigint").alias("lines_removed"))
    both = kv_store.by_priority([edits, fates.unionByName(edits)], ["session_id", "path"])
    assert sorted((r["path"], r["stage"]) for r in both.collect()) == [("/r/x", 0), ("/r/y", 1)]


def test_paths_of_diffs_without_one(spark):
    rows = spark.createDataFrame([("s", "1", "a", True, False, False, 0), ("s", "1", "b", False, True, True, 9), ("s", "2", "a", False, False, True, 0), ("s", "3", "a", False, True, False, 2), ("s", "3", "b", False, True, False, 2)], "session_id string, item string, path string, open_file boolean, attached boolean, mentioned boolean, content_lines int")
    assert [(r["item"], r["path"]) for r in kv_store.resolved_paths(rows).collect()] == [("1", "a")]


def test_stream_reads_each_file_once(spark, tmp_path):
    lines(spark, tmp_path, "a.jsonl", [{"type": "user", "message": {"content": "hello there"}}])
    run = lambda: ingest.ingest(ingest.new_lines(spark, str(tmp_path / "p")), lambda x: claude_logs.messages(claude_logs.records(x)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    lines(spark, tmp_path, "b.jsonl", [{"type": "user", "message": {"content": "again"}}])
    run()
    run()
    assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["again", "hello there"]


def test_live_pastes(spark):
    rows = spark.createDataFrame([("c", "user", "2026-03-01 00:00:00", "TypeError: x"), ("c", "user", "2026-03-01 00:10:00", "fine"), ("c", "user", "2026-03-01 02:00:00", "fine"), ("c", "assistant", "2026-03-01 02:00:00", "TypeError: x")], "provider string, role string, t string, content string")
    got = ingest.live_error_pastes(rows.withColumn("message_ts", F.col("t").cast("timestamp"))).orderBy("window_start").collect()
    assert [(r["n_messages"], r["n_pastes"]) for r in got] == [(2, 1), (1, 0)]


def test_store_changes_by_stage(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "session_id string, path string, lines_added int, lines_removed int")
    found = store_changes.cascade(rows(("s", "a", 1, 0)), rows(("s", "a", 9, 9), ("s", "b", 2, 0)), rows(("s", "b", 9, 9), ("t", "a", 3, 0)), rows(("s", "c", 4, 0), ("t", "a", 9, 9)))
    assert sorted((r["session_id"], r["path"], r["lines_added"], r["stage"]) for r in found.collect()) == [("s", "a", 1, 0), ("s", "b", 2, 1), ("s", "c", 4, 3), ("t", "a", 3, 2)]


def test_project_path_is_a_repository(spark):
    hints = spark.createDataFrame([("s", 2, "file:///r/x%20y/src/a/f.py"), ("s", 2, "/r/x y/src/b/g.py"), ("s", 3, "/elsewhere"), ("t", 1, "/w/only.py"), ("u", 0, "/p/a"), ("u", 0, "/q/b")], "session_id string, source int, path string")
    repos = spark.createDataFrame([("/r",), ("/r/x y",), ("/r/x y/src/a",)], "repo_root string")
    assert {r["session_id"]: r["project_path"] for r in store_changes.project_paths(hints).collect()} == {"s": "/r/x y/src", "t": "/w", "u": ""}
    assert {r["session_id"]: r["project_path"] for r in store_changes.project_paths(hints, repos).collect()}["s"] == "/r/x y"


def test_store_key_ranges():
    assert kv_store.key_range("bubbleId") == ("bubbleId:", "bubbleId;") and kv_store.key_range("inlineDiffUndoRedo") == ("inlineDiffUndoRedo-", "inlineDiffUndoRedo.")


def test_lines_of_files_read_in_pieces(spark, tmp_path):
    """Numbers of lines, blank ones too, are those of the file, however many tasks read it."""
    texts = {f"{k}.jsonl": "".join(f"{k} {i} {'x' * (i * 7 % 50)}" + ("\n\n" if i % 5 == 0 else "\r\n" if i % 7 == 0 else "\n") for i in range(n)) + last for k, n, last in ((1, 900, ""), (2, 0, ""), (3, 1, "no end"), (4, 300, "\n \n"))}
    for name, text in texts.items():
        (tmp_path / "deep" / name[0]).mkdir(parents=True)
        (tmp_path / "deep" / name[0] / name).write_bytes(text.encode())
    want = sorted((name, i, line) for name, text in texts.items() for i, line in enumerate(text.split("\n")) if line.strip(" "))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            found = files.log_lines(spark, str(tmp_path))
            assert sorted((r["source_file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in found.collect()) == want
            assert size != "1000b" or files.raw_lines(spark.read, str(tmp_path)).select("source_file", "_piece").distinct().count() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    listed = {r["source_file"].rsplit("/", 1)[1]: r["size"] for r in files.log_files(spark, str(tmp_path)).collect()}
    assert listed == {name: len(text.encode()) for name, text in texts.items() if text}
    assert files.log_files(spark, str(tmp_path / "deep" / "1"), recursive=False).count() == 1


def test_store_through_jdbc(spark, tmp_path):
    """Kinds and sessions are read from a database by ranges of keys, each row once, also where a session's name begins another's."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    keys = ["composerData:a", "composerData:a1", "composerData:it's", "bubbleId:a:1", "bubbleId:a:2", "bubbleId:a1:1", "bubbleId:b:1", "inlineDiffUndoRedo-a:9", "inlineDiff:a:9", "codeBlockDiff:b:x:y", "unknownKind:a:1", "bubbleIdx:a:1"]
    rows = spark.createDataFrame([(k, f"{{{i}}}") for i, k in enumerate(keys)], "key string, value string")
    rows.write.option("createTableColumnTypes", "key VARCHAR(200)").jdbc(url, "cursorDiskKV", mode="overwrite")
    read = lambda *sessions: kv_store.read_store(spark, url, sessions=sessions)
    assert sorted(r["key"] for r in read().collect()) == sorted(keys[:10])
    assert read().rdd.getNumPartitions() == len(kv_store.PREFIXES)
    assert sorted(r["key"] for r in read("a", "a1", "it's", "a").collect()) == sorted(k for k in keys[:10] if k not in ("bubbleId:b:1", "codeBlockDiff:b:x:y"))
    assert sorted(r["key"] for r in read("a").collect()) == sorted(["composerData:a", "bubbleId:a:1", "bubbleId:a:2", "inlineDiffUndoRedo-a:9", "inlineDiff:a:9"])
    assert {(r["kind"], r["session_id"], r["item"]) for r in kv_store.entries(read("b")).collect()} == {("bubbleId", "b", "1"), ("codeBlockDiff", "b", "x:y")}
