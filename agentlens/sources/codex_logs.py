"""Session logs of the second kind: an envelope of type, timestamp and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.columns import word_count

ITEMS = "array<struct<type:string,text:string>>"


def records(lines: DataFrame) -> DataFrame:
    """Records of files whose first line is a session's head."""
    j = lambda path: F.get_json_object("value", path)
    rows = lines.select("source_file", "line_no", "value", j("$.type").alias("type"), j("$.timestamp").try_cast("timestamp").alias("at"), j("$.payload").alias("payload"))
    first = Window.partitionBy("source_file").orderBy("line_no")
    return rows.withColumn("_head", F.first("type").over(first)).filter(F.col("_head") == "session_meta").drop("_head", "value")


def payload(path: str):
    return F.get_json_object("payload", f"$.{path}")


def sessions(rows: DataFrame) -> DataFrame:
    """(source_file, session_id, cwd, model_provider, model_name, started_at, ended_at): the first model named counts."""
    heads = rows.filter("line_no = 0").select("source_file", payload("id").alias("session_id"), payload("cwd").alias("cwd"), payload("model_provider").alias("model_provider"), F.coalesce(payload("timestamp").try_cast("timestamp"), "at").alias("started_at"))
    models = rows.filter("type = 'turn_context'").withColumn("m", payload("model")).groupBy("source_file").agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("line_no"))).alias("model_name"))
    ends = rows.groupBy("source_file").agg(F.max("at").alias("ended_at"))
    return heads.filter(F.col("session_id").isNotNull()).join(models, "source_file", "left").join(ends, "source_file")


def messages(rows: DataFrame) -> DataFrame:
    users = rows.filter((F.col("type") == "event_msg") & (payload("type") == "user_message")).select("source_file", "line_no", "at", F.lit("user").alias("role"), payload("message").alias("content"))
    texts = F.array_join(F.transform(F.filter(F.from_json(payload("content"), ITEMS), lambda x: (x["type"] == "output_text") & x["text"].isNotNull()), lambda x: x["text"]), "")
    replies = rows.filter((F.col("type") == "response_item") & (payload("role") == "assistant")).select("source_file", "line_no", "at", F.lit("assistant").alias("role"), texts.alias("content"))
    said = users.unionByName(replies).withColumn("content_words", word_count(F.col("content"))).filter("content_words > 0")
    return said.select("source_file", F.col("line_no").alias("message_index"), F.col("at").alias("message_ts"), "role", "content", "content_words")


def tool_calls(rows: DataFrame) -> DataFrame:
    """Calls that succeeded (source_file, call_id, line_no, at, name, input): each with its output, by the rules of its tool."""
    items = rows.filter("type = 'response_item'").withColumn("kind", payload("type"))
    calls = items.filter(F.col("kind").isin("function_call", "custom_tool_call")).select("source_file", payload("call_id").alias("call_id"), "line_no", "at", payload("name").alias("name"), F.coalesce(payload("arguments"), payload("input")).alias("input"))
    outputs = items.filter(F.col("kind").isin("function_call_output", "custom_tool_call_output")).select("source_file", payload("call_id").alias("call_id"), payload("output").alias("output"), F.col("line_no").alias("_line"))
    last = outputs.groupBy("source_file", "call_id").agg(F.max_by("output", "_line").alias("output"))
    exited = F.contains("output", F.lit("Process exited with code 0"))
    patched = F.get_json_object("output", "$.metadata.exit_code").try_cast("int") == 0
    good = F.when(F.col("name") == "apply_patch", patched).when(F.col("name") == "exec_command", exited)  # no other tool changes files
    return calls.join(last, ["source_file", "call_id"], "left").filter(F.coalesce(good, F.lit(False)))


def commands(calls: DataFrame) -> DataFrame:
    """Shell commands of calls."""
    return calls.filter("name = 'exec_command'").withColumn("cmd", F.get_json_object("input", "$.cmd")).withColumn("workdir", F.get_json_object("input", "$.workdir"))
