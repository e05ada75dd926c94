"""Session logs of the first kind: typed records with content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.functions.columns import word_count
from agentlens.functions.hashing import line_hash, text_hashes, with_line_diff
from agentlens.sources.files import file_stem

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,toolUseId:string,is_error:boolean,content:string>>"
HIDDEN_TEXT = "[Request interrupted by user for tool use]"


def records(lines: DataFrame) -> DataFrame:
    """One row for each record; `content` is a text or an array of blocks, and both are read."""
    j = lambda path: F.get_json_object("value", path)
    content = j("$.message.content")
    known = lines.select(
        "source_file", "line_no", j("$.type").alias("type"), j("$.timestamp").alias("ts"), j("$.sessionId").alias("_session"), j("$.cwd").alias("cwd"),
        F.coalesce(j("$.isMeta").try_cast("boolean"), F.lit(False)).alias("is_meta"), j("$.message.model").alias("model"), content.alias("content"),
        F.when(content.startswith("["), F.from_json(content, BLOCKS)).alias("blocks"), j("$.toolUseResult").alias("result"), j("$.data.message").alias("nested"), j("$.data.type").alias("data_type"),
    )
    return known.withColumn("at", F.col("ts").try_cast("timestamp"))


def joined_text(blocks: str) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def sessions(rows: DataFrame) -> DataFrame:
    """(source_file, session_id, cwd, model_name, started_at, ended_at): last names win, a file without an id is named by its stem."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    real = rows.withColumn("model", F.when((F.col("type") == "assistant") & ~F.trim("model").isin("", "<synthetic>"), F.trim("model")))
    grouped = real.groupBy("source_file").agg(last("_session").alias("s"), last("cwd").alias("cwd"), last("model").alias("model_name"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
    return grouped.select("source_file", F.coalesce("s", file_stem(F.col("source_file"))).alias("session_id"), "cwd", "model_name", "started_at", "ended_at")


def messages(rows: DataFrame) -> DataFrame:
    """Visible texts (source_file, message_index, message_ts, role, content, content_words)."""
    has_result = F.exists(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False)))
    text = F.when(F.col("blocks").isNotNull(), joined_text("blocks")).when(F.col("type") == "user", F.col("content"))
    said = rows.filter(F.col("type").isin("user", "assistant")).withColumn("text", text).withColumn("_trim", F.regexp_replace("text", r"^\s+|\s+$", ""))
    t = F.col("_trim")
    hidden = (t == HIDDEN_TEXT) | F.contains(t, F.lit("<local-command-caveat>")) | F.contains(t, F.lit("<command-name>/")) | t.startswith("<command-")
    seen = said.filter((t != "") & ((F.col("type") == "assistant") | ~(F.col("is_meta") | has_result | hidden)))
    return seen.select("source_file", F.col("line_no").alias("message_index"), F.col("at").alias("message_ts"), F.col("type").alias("role"), F.col("text").alias("content"), word_count(F.col("text")).alias("content_words"))


def tool_calls(rows: DataFrame) -> DataFrame:
    """Calls with their results (source_file, call_id, name, input, result, failed, at), from records and from nested progress records."""
    inner = lambda path: F.get_json_object("nested", path)
    nested = rows.filter(F.col("nested").isNotNull()).withColumns({"type": inner("$.type"), "content": inner("$.message.content"), "at": F.coalesce(inner("$.timestamp").try_cast("timestamp"), F.col("at"))})
    nested = nested.withColumn("blocks", F.when(F.col("content").startswith("["), F.from_json("content", BLOCKS)))
    every = rows.filter(F.col("type").isin("user", "assistant")).unionByName(nested).filter(F.col("blocks").isNotNull())
    flat = every.select("source_file", "line_no", "type", "result", "at", F.posexplode("blocks").alias("place", "b"))
    uses = flat.filter((F.col("type") == "assistant") & (F.col("b.type") == "tool_use") & F.col("b.id").isNotNull() & F.col("b.name").isNotNull())
    uses = uses.select("source_file", "line_no", "place", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"), F.col("b.input").alias("input"), "at")
    results = flat.filter((F.col("type") == "user") & (F.col("b.type") == "tool_result")).select("source_file", F.coalesce("b.tool_use_id", "b.toolUseId").alias("call_id"), "line_no", "result", F.coalesce("b.is_error", F.lit(False)).alias("failed"))
    final = results.groupBy("source_file", "call_id").agg(F.max_by(F.struct("result", "failed"), "line_no").alias("r")).select("source_file", "call_id", "r.*")
    return uses.join(final, ["source_file", "call_id"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def writes(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted edits and writes: (source_file, call_id, path, mode, before_known, lines_added, lines_removed, at) and their hashes."""
    r, i = (lambda p: F.get_json_object("result", p)), (lambda p: F.get_json_object("input", p))
    path = F.coalesce(r("$.filePath"), i("$.file_path"))
    done = calls.filter(~F.col("failed") & F.col("result").startswith("{") & F.col("name").isin("Edit", "Write")).withColumn("path", path)
    done = done.filter(F.col("path").isNotNull() & ~F.contains(F.regexp_replace("path", r"\\", "/"), F.lit("/.claude/plans/")))
    keys = ["source_file", "call_id", "path", "at"]
    edits = done.filter("name = 'Edit'").select(*keys, F.coalesce(r("$.oldString"), i("$.old_string")).alias("old"), F.coalesce(r("$.newString"), i("$.new_string")).alias("new"), F.lit("patch").alias("mode"), F.lit(True).alias("before_known"))
    files = done.filter("name = 'Write'").select(
        *keys, F.coalesce(r("$.type"), i("$.type")).alias("kind"), F.coalesce(r("$.content"), i("$.content")).alias("new"), r("$.originalFile").alias("original"),
        F.flatten(F.transform(F.from_json(r("$.structuredPatch"), "array<struct<lines:array<string>>>"), lambda h: F.coalesce(h["lines"], F.array().cast("array<string>")))).alias("lines"),
    ).filter(F.col("new").isNotNull())
    signed = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.startswith("+") | x.startswith("-"))
    files = files.withColumn("signed", signed).withColumn("created", F.coalesce(F.col("kind") == "create", F.lit(False)))
    patched = files.filter(~F.col("created") & (F.size("signed") > 0))
    whole = files.filter(F.col("created") | (F.size("signed") == 0)).withColumn("before_known", ~F.col("created") & F.col("original").isNotNull())
    whole = whole.select(*keys, F.when(F.col("before_known"), F.col("original")).otherwise("").alias("old"), "new", F.lit("overwrite").alias("mode"), "before_known")
    diffed = with_line_diff(edits.filter(F.col("old").isNotNull() & F.col("new").isNotNull()).unionByName(whole), "old", "new")
    changes = diffed.select(*keys, "mode", "before_known", F.explode("changes").alias("c")).select(*keys, "mode", "before_known", "c.side", "c.line")
    lines = patched.select(*keys, F.lit("patch").alias("mode"), F.lit(True).alias("before_known"), F.explode("signed").alias("s")).select(*keys, "mode", "before_known", F.substring("s", 1, 1).alias("side"), F.substring("s", 2, 1 << 30).alias("line"))
    every = changes.unionByName(lines)
    number = lambda s: F.count(F.when(F.col("side") == s, 1))
    ops = every.groupBy(*keys, "mode", "before_known").agg(number("+").alias("lines_added"), number("-").alias("lines_removed"))
    hashes = every.groupBy("source_file", "call_id", "path", "side", line_hash(F.col("line")).alias("line_hash")).agg(F.count("*").alias("count"))
    return ops, hashes


__all__ = ["messages", "records", "sessions", "text_hashes", "tool_calls", "writes"]
