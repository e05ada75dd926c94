"""Sessions in a key-value store: one scan, with the record's type in the key's prefix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.functions.columns import word_count

PREFIXES = ("composerData", "bubbleId", "checkpointId", "inlineDiffUndoRedo", "inlineDiff", "codeBlockPartialInlineDiffFates", "codeBlockDiff")
WRITERS = ("edit_file_v2", "apply_patch", "write_file", "write_file_v2")
PATH_KEYS = ("relativeWorkspacePath", "targetFile", "target_file", "effectiveUri", "path")
HEADERS = "array<struct<bubbleId:string,type:int>>"


def key_range(prefix: str) -> tuple[str, str]:
    """From the first key of a kind until before the first that is no more of it."""
    mark = "-" if prefix == "inlineDiffUndoRedo" else ":"
    return f"{prefix}{mark}", f"{prefix}{chr(ord(mark) + 1)}"


def key_conditions(sessions: Sequence[str] = ()) -> list[str]:
    """SQL conditions on keys, no two of which hold for one key: one for each kind, or each kind and session."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    within = lambda low, high: f'("key" >= {quoted(low)} AND "key" < {quoted(high)})'
    if not sessions:
        return [within(*key_range(p)) for p in PREFIXES]
    heads = [key_range(p)[0] + s for p in PREFIXES for s in dict.fromkeys(sessions)]
    return [f'("key" = {quoted(h)} OR {within(f"{h}:", f"{h};")})' for h in heads]  # not those of a session that begins with this one's name


def read_store(spark: SparkSession, url: str, table: str = "cursorDiskKV", sessions: Sequence[str] = ()) -> DataFrame:
    """(key, value) of a store that a JDBC driver reaches, in a task for each of `key_conditions`, which the store's index of keys answers."""
    return spark.read.jdbc(url, table, predicates=key_conditions(sessions)).select("key", "value")


def entries(store: DataFrame) -> DataFrame:
    """(kind, session_id, item, value): keys are `kind:session:item`; the undo kind parts with a dash. The ranges reach the scan."""
    within = lambda p: (F.col("key") >= key_range(p)[0]) & (F.col("key") < key_range(p)[1])
    kind = F.coalesce(*[F.when(within(p), p) for p in PREFIXES])
    wanted = reduce(lambda a, b: a | b, map(within, PREFIXES))
    parts = F.split(F.regexp_replace("key", "^[A-Za-z]+[:-]", ""), ":", 2)
    return store.filter(wanted).select(kind.alias("kind"), parts[0].alias("session_id"), F.get(parts, F.lit(1)).alias("item"), "value")


def sessions(rows: DataFrame) -> DataFrame:
    j = lambda p: F.get_json_object("value", p)
    time = lambda p: F.timestamp_millis(j(p).try_cast("bigint"))
    heads = rows.filter("kind = 'composerData'")
    return heads.select(F.coalesce(j("$.composerId"), "session_id").alias("session_id"), time("$.createdAt").alias("started_at"), time("$.lastUpdatedAt").alias("ended_at"), j("$.modelConfig.modelName").alias("model_name"), F.from_json(j("$.fullConversationHeadersOnly"), HEADERS).alias("headers"))


def bubbles(rows: DataFrame) -> DataFrame:
    """Messages in order of the session's headers (then of their ids): (session_id, message_index, role, content, model_name, tool fields)."""
    j = lambda p: F.get_json_object("value", p)
    own = rows.filter("kind = 'bubbleId'").select(
        "session_id", F.col("item").alias("bubble_id"), j("$.type").try_cast("int").alias("type"), j("$.text").alias("content"), F.timestamp_millis(j("$.createdAt").try_cast("bigint")).alias("message_ts"),
        j("$.modelInfo.modelName").alias("model_name"), j("$.toolFormerData.name").alias("tool"), j("$.toolFormerData.status").alias("status"), j("$.toolFormerData.params").alias("params"), j("$.toolFormerData.result").alias("result"),
    )
    # a bubble that the headers name twice has its last place
    order = sessions(rows).select("session_id", F.posexplode("headers").alias("_at", "h")).groupBy("session_id", F.col("h.bubbleId").alias("bubble_id")).agg(F.max("_at").alias("message_index"))
    role = F.when(F.col("type") == 1, "user").when(F.col("type") == 2, "assistant")
    return own.join(order, ["session_id", "bubble_id"], "left").withColumn("role", role)


def messages(rows: DataFrame) -> DataFrame:
    said = bubbles(rows).withColumn("content_words", word_count(F.col("content"))).filter(F.col("role").isNotNull() & (F.col("content_words") > 0))
    return said.select("session_id", "message_index", "message_ts", "role", "content", "content_words")


def tool_edits(rows: DataFrame) -> DataFrame:
    """(session_id, path, lines_added, lines_removed): finished writes of one path, summed by path."""
    calls = bubbles(rows).filter(F.col("tool").isin(*WRITERS) & F.coalesce(F.col("status") == "completed", F.lit(False)))
    named = F.array(*[F.get_json_object("params", f"$.{k}") for k in PATH_KEYS])
    listed = F.transform(F.from_json(F.get_json_object("params", "$.paths"), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.relativeWorkspacePath"), x))
    every = F.array_distinct(F.array_compact(F.concat(named, F.coalesce(listed, F.array().cast("array<string>")))))
    path = F.when(F.size(every) == 1, every[0])  # a call that names several tells of none
    diffs = F.regexp_extract_all(F.coalesce("result", F.lit("")), F.lit(r'"diffString"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    lines = F.flatten(F.transform(diffs, lambda d: F.split(F.get_json_object(F.concat(F.lit('{"x":'), d, F.lit("}")), "$.x"), "\n")))
    count = lambda sign: F.size(F.filter("lines", lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    counted = calls.withColumn("path", path).withColumn("lines", lines).withColumn("a", count("+")).withColumn("r", count("-"))
    real = counted.filter(F.col("path").isNotNull() & ((F.col("a") > 0) | (F.col("r") > 0)))
    return real.groupBy("session_id", "path").agg(F.sum("a").alias("lines_added"), F.sum("r").alias("lines_removed"))


def by_priority(stages: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of the first stage that has any for a key: a later stage is asked only for what earlier ones leave."""
    chosen = stages[0].withColumn("stage", F.lit(0))
    for n, rows in enumerate(stages[1:], 1):
        chosen = chosen.unionByName(rows.join(chosen.select(*keys).distinct(), keys, "left_anti").withColumn("stage", F.lit(n)))
    return chosen


def accepted_fates(rows: DataFrame) -> DataFrame:
    """(session_id, item, path, added): lines of partial diffs whose fate is accepted."""
    fates = rows.filter("kind = 'codeBlockPartialInlineDiffFates'")
    j = lambda p: F.get_json_object("value", p)
    lines = F.filter(F.from_json(j("$.fates"), "array<struct<fate:string,line:string>>"), lambda x: x["fate"] == "accepted")
    return fates.select("session_id", "item", j("$.path").alias("path"), F.transform(lines, lambda x: x["line"]).alias("added")).filter(F.size("added") > 0)


SIGNALS = (("open_file", 100), ("attached", 10), ("mentioned", 1))


def resolved_paths(candidates: DataFrame) -> DataFrame:
    """(session_id, item, path): a path for each diff without one, if one candidate is best alone and has more than a mention.

    `candidates` are (session_id, item, path, open_file, attached, mentioned, content_lines).
    """
    from pyspark.sql import Window

    score = sum((F.col(name).cast("int") * weight for name, weight in SIGNALS), F.lit(0))
    order = Window.partitionBy("session_id", "item").orderBy(F.desc("_score"), F.desc("content_lines"), "path")
    ranked = candidates.withColumn("_score", score).withColumn("_rank", F.row_number().over(order))
    same = (F.lead("_score").over(order) == F.col("_score")) & (F.lead("content_lines").over(order) == F.col("content_lines"))
    firm = F.col("open_file") | F.col("attached") | (F.col("content_lines") > 0)
    return ranked.withColumn("_tie", F.coalesce(same, F.lit(False))).filter((F.col("_rank") == 1) & ~F.col("_tie") & firm).select("session_id", "item", "path")


def history_changes(entries_: DataFrame) -> DataFrame:
    """(path, id, timestamp, before, after): a version of a file and the next one."""
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("timestamp", "id")
    return entries_.withColumn("before", F.col("content")).withColumn("after", F.lead("content").over(order)).filter(F.col("after").isNotNull()).drop("content")
