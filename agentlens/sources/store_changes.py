"""Changes, paths and models that a key-value store's records tell, as stages of which a later one is asked for what earlier ones leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.hashing import with_line_diff
from agentlens.sources.kv_store import by_priority

# fixed values: keys that name a model, and parts of models' names
MODEL_KEYS = ("model", "modelName", "currentModel", "selectedModel", "defaultModel", "defaultModelSlug", "chatModel")
MODEL_PARTS = ("gpt", "claude", "gemini", "sonnet", "haiku", "opus", "o1", "o3", "deepseek", "llama", "qwen")
PLANS = "/.cursor/plans/"
CHANGE = "array<struct<removedTextLines:array<string>,addedTextLines:array<string>,addedRange:struct<startLineNumber:bigint,endLineNumberExclusive:bigint>>>"
LINES = "array<string>"


def none() -> Column:
    return F.array().cast(LINES)


def bare_path(path: Column) -> Column:
    """A path of a URI: without its scheme and percent codes."""
    return F.when(path.startswith("file://"), F.try_url_decode(F.regexp_replace(F.regexp_replace(path, "^file://", ""), r"\+", "%2B"))).otherwise(path)


def model_name(value: str) -> Column:
    """The first model that a JSON text names at any depth under one of `MODEL_KEYS`; `default` only if there is no other."""
    found = F.regexp_extract_all(value, F.lit(rf'"(?:{"|".join(MODEL_KEYS)})"\s*:\s*(?:\{{\s*"(?:name|slug|id|model)"\s*:\s*)?"\s*([^"]*?)\s*"'), F.lit(1))
    used = F.regexp_extract_all(value, F.lit(r'"usageData"\s*:\s*\{\s*"([^"]+)"'), F.lit(1))
    every = F.concat(used, found)
    known = F.filter(every, lambda x: F.lower(x).rlike("|".join(MODEL_PARTS)))
    fallback = F.when(F.exists(every, lambda x: F.lower(x) == "default"), F.lit("default"))
    return F.coalesce(F.get(known, F.lit(0)), fallback)


def project_paths(hints: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(session_id, project_path): the common ancestor of a session's paths, or the repository's root that holds it.

    `hints` are (session_id, source, path): only those of a session's first source count (0 selections, 1 attachments,
    2 original states, 3 code blocks). `repos` are (repo_root).
    """
    first = hints.groupBy("session_id").agg(F.min("source").alias("source"))
    parts = hints.join(first, ["session_id", "source"]).select("session_id", F.split(bare_path(F.col("path")), "/").alias("_parts")).distinct()
    placed = parts.select("session_id", F.posexplode("_parts").alias("_at", "_part"))
    n = parts.groupBy("session_id").agg(F.count("*").alias("_n"))
    shared = placed.groupBy("session_id", "_at").agg(F.count_distinct("_part").alias("_kinds"), F.count("*").alias("_have"), F.min("_part").alias("_part")).join(n, "session_id")
    broken = F.max(((F.col("_kinds") > 1) | (F.col("_have") < F.col("_n"))).cast("int")).over(Window.partitionBy("session_id").orderBy("_at"))
    common = shared.withColumn("_broken", broken).filter("_broken = 0").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_all"))
    names = common.select("session_id", F.transform("_all", lambda x: x["_part"]).alias("_names"))
    last = F.element_at("_names", -1)
    folder = F.when(last.rlike(r"^.+\.[^.]+$"), F.slice("_names", F.lit(1), F.size("_names") - 1)).otherwise(F.col("_names"))
    paths = names.select("session_id", F.array_join(folder, "/").alias("project_path"))
    if repos is None:
        return paths
    # every prefix of a path is a key, so the repository that holds it is found by an equi-join
    steps = F.split("project_path", "/")
    prefixes = paths.select("session_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("repo_root"))
    roots = prefixes.join(repos.select("repo_root").distinct(), "repo_root").groupBy("session_id").agg(F.max_by("repo_root", F.char_length("repo_root")).alias("_root"))
    return paths.join(roots, "session_id", "left").select("session_id", F.coalesce("_root", "project_path").alias("project_path"))


def targets(sessions: DataFrame, blocks: str) -> DataFrame:
    """(session_id, path, partial_id, diff_id, content, version, idx, applied): accepted code blocks; a file has a list or an object of them."""
    files = sessions.select("session_id", F.explode(F.from_json(blocks, "map<string,string>")).alias("_file", "_value"))
    each = F.when(F.col("_value").startswith("["), F.from_json("_value", LINES)).otherwise(F.map_values(F.from_json("_value", "map<string,string>")))
    j = lambda p: F.get_json_object("_entry", p)
    rows = files.select("session_id", "_file", F.explode(each).alias("_entry")).filter(F.coalesce(j("$.status") == "accepted", F.lit(False)))
    path = bare_path(F.coalesce(j("$.uri.fsPath"), j("$.uri.path"), F.col("_file")))
    held = lambda p: F.coalesce(j(p).try_cast("boolean"), F.lit(False))
    number = lambda p: F.coalesce(j(p).try_cast("int"), F.lit(0))
    told = rows.select(
        "session_id", path.alias("path"), j("$.partialInlineDiffFatesId").alias("partial_id"), j("$.diffId").alias("diff_id"), j("$.content").alias("content"),
        number("$.version").alias("version"), number("$.codeBlockIdx").alias("idx"), (~held("$.isNotApplied") & ~held("$.isNoOp")).alias("applied"),
    )
    return told.filter(~F.contains("path", F.lit(PLANS))).distinct()


def inline_changes(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, added, removed, error): lines that an inline record adds and removes; a range counts from 1 and ends before its end."""
    new = F.coalesce(F.from_json(F.get_json_object(value, "$.newTextLines"), LINES), none())
    changes = F.from_json(F.get_json_object(value, "$.changes"), CHANGE)
    read = rows.select(*keys, new.alias("_new"), changes.alias("_changes"))
    start, end = (lambda c: c["addedRange"]["startLineNumber"]), (lambda c: c["addedRange"]["endLineNumberExclusive"])
    ranged = lambda c: c["addedTextLines"].isNull() & c["addedRange"].isNotNull()
    outside = lambda c: ranged(c) & F.coalesce((start(c) < 1) | (end(c) < start(c)) | (end(c) - 1 > F.size("_new")), F.lit(True))
    cut = lambda c: F.when(ranged(c), F.slice("_new", start(c).cast("int"), (end(c) - start(c)).cast("int"))).otherwise(F.coalesce(c["addedTextLines"], none()))
    bad = F.exists("_changes", outside)
    lines = lambda f: F.when(F.col("_changes").isNull() | bad, none()).otherwise(F.flatten(F.transform("_changes", f)))
    told = read.withColumns({"added": lines(cut), "removed": lines(lambda c: F.coalesce(c["removedTextLines"], none()))})
    empty = (F.size("added") == 0) & (F.size("removed") == 0)
    error = F.when(F.col("_changes").isNull(), "no changes").when(bad, "a range out of bounds").when(empty, "no lines added or removed")
    return told.select(*keys, "added", "removed", error.alias("error"))


def history_lines(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, path, lines_added, lines_removed): what undo entries of the local history tell of a session's paths.

    `history` are (path, id, timestamp, source, content), `wanted` are (session_id, path, begin_ms, end_ms). The text
    before a change is an undo entry's, the one after it is the next entry's (empty if there is none).
    """
    order = Window.partitionBy("path").orderBy("timestamp", "id")
    asked = wanted.filter("begin_ms <= end_ms")
    texts = history.join(asked.select("path").distinct(), "path", "left_semi")
    versions = texts.withColumn("_after", F.coalesce(F.lead("content").over(order), F.lit(""))).filter(F.col("source").startswith("Undo") & F.col("timestamp").isNotNull())
    # a version is compared once, however many sessions want it: they take the difference of running sums
    counted = with_line_diff(versions.select("path", F.col("timestamp").alias("_t"), "content", "_after"), "content", "_after").select("path", "_t", F.lit(1).alias("_kind"), "added", "removed")
    mark = lambda t, kind: asked.select("path", F.col(t).alias("_t"), F.lit(kind).alias("_kind"), "session_id")
    rows = counted.unionByName(mark("begin_ms", 0).unionByName(mark("end_ms", 2)), allowMissingColumns=True)
    until = Window.partitionBy("path").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_added": F.coalesce(F.sum("added").over(until), F.lit(0)), "_removed": F.coalesce(F.sum("removed").over(until), F.lit(0)), "_n": F.sum((F.col("_kind") == 1).cast("int")).over(until)}
    between = lambda c: F.sum((F.col("_kind") - 1) * F.col(c))
    told = rows.withColumns(sums).filter("_kind <> 1").groupBy("session_id", "path").agg(between("_added").alias("lines_added"), between("_removed").alias("lines_removed"), between("_n").alias("_n"))
    return told.filter("_n > 0").drop("_n")


def legacy_changes(blocks: DataFrame) -> DataFrame:
    """(session_id, path, lines_added, lines_removed): versions of a code block against the version before, of `targets`."""
    order = Window.partitionBy("session_id", "path").orderBy("version", "idx", F.coalesce("diff_id", F.lit("")))
    versions = blocks.filter("applied AND content IS NOT NULL").withColumn("_before", F.coalesce(F.lag("content").over(order), F.lit("")))
    counted = with_line_diff(versions.select("session_id", "path", "_before", "content"), "_before", "content")
    return counted.groupBy("session_id", "path").agg(F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed")).filter("lines_added + lines_removed > 0")


RANK = ("historical_removed", "live_added", "live_removed", "checkpoint", "strong_hint", "weak_hint", "basename", "proximity")
#: What the parts of a rank weigh in its first and second score; fixed values of the rule.
FIRST, SECOND = (100, 10, 1), (100, 10, 5, 2, 1)


def confident_paths(candidates: DataFrame) -> DataFrame:
    """(session_id, item, path): for each diff without a path the best candidate by its eight-part rank, if it is sure enough.

    `candidates` are (session_id, item, path, *RANK). The winner needs lines in common (two, if only removed ones of the
    present text), and a higher first score than the next, or the same and a higher second one with more lines in common.
    """
    score = lambda names, weights: sum((F.col(n) * w for n, w in zip(names, weights)), F.lit(0))
    scored = candidates.withColumn("_rank", F.struct(*RANK)).withColumn("_first", score(RANK[:3], FIRST)).withColumn("_second", score(RANK[3:], SECOND))
    order = Window.partitionBy("session_id", "item").orderBy(F.desc("_rank"), "path")
    nexts = {f"_n{c}": F.lead(c).over(order) for c in ("_rank", "_first", "_second")}
    top = scored.withColumns(nexts).withColumn("_place", F.row_number().over(order)).filter("_place = 1 AND _first > 0")
    removed, added, gone = (F.col(c) for c in RANK[:3])
    some, more = (removed > 0) | (added > 0) | (gone >= 2), (removed > 0) | (added >= 2) | (gone >= 2)
    alone = F.col("_n_rank").isNull()
    ahead = F.col("_first") > F.col("_n_first")
    even = (F.col("_first") == F.col("_n_first")) & (F.col("_second") > F.col("_n_second"))
    sure = F.when(alone, some).when(F.col("_rank") == F.col("_n_rank"), F.lit(False)).when(ahead, some).otherwise(even & more)
    return top.filter(sure).select("session_id", "item", "path")


def cascade(tool_edits: DataFrame, inline: DataFrame, fates: DataFrame, legacy: DataFrame) -> DataFrame:
    """(session_id, path, lines_added, lines_removed, stage): tool writes, inline records, accepted partial diffs, code blocks, in this order."""
    columns = ["session_id", "path", "lines_added", "lines_removed"]
    return by_priority([df.select(*columns) for df in (tool_edits, inline, fates, legacy)], ["session_id", "path"])
