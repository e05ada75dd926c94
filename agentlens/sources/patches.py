"""Patch texts as rows, without a parser loop: lines are numbered, a running count of
file headers names the block that a line belongs to, and blocks are aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.hashing import line_hash, lines_of

BLOCK = "_block"


def numbered(df: DataFrame, keys: list[str], text: str, header: Column) -> DataFrame:
    """(keys, line_no, line, _block); lines before the first header are left out."""
    lines = df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    running = Window.partitionBy(*keys).orderBy("line_no")
    return lines.withColumn(BLOCK, F.sum(header.cast("int")).over(running)).filter(F.col(BLOCK) > 0)


def rest_of(prefix: str) -> Column:
    return F.when(F.startswith("line", F.lit(prefix)), F.trim(F.substring("line", len(prefix) + 1, 1 << 30)))


def patch_path(path: Column) -> Column:
    """A path of a diff's header: without `a/` or `b/`, quotes and what follows a tab; /dev/null is none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\t.*$", ""), '^"(.*)"$', "$1"), "^[ab]/", "")
    return F.when(path != "/dev/null", bare)


def sided(lines: DataFrame) -> DataFrame:
    """Added and removed lines, with their hashes."""
    line = F.col("line")
    side = F.when(line.startswith("+") & ~line.startswith("+++"), "+").when(line.startswith("-") & ~line.startswith("---"), "-")
    return lines.withColumn("side", side).filter(F.col("side").isNotNull()).withColumn("line_hash", line_hash(F.substring("line", 2, 1 << 30)))


def unified_diff(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Files (keys, rel_path, change_type, added_lines, removed_lines) and their hashes (keys, rel_path, side, line_hash, count)."""
    lines = numbered(df, keys, text, F.startswith("line", F.lit("diff --git ")))
    place = [*keys, BLOCK]
    line = F.col("line")
    kind = F.when(line.startswith("new file mode "), "add").when(line.startswith("deleted file mode "), "delete").when(line.startswith("rename "), "rename").when(line.startswith("copy "), "copy")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    new = F.coalesce(rest_of("rename to "), rest_of("copy to "), patch_path(rest_of("+++ ")))
    old = F.coalesce(rest_of("rename from "), rest_of("copy from "), patch_path(rest_of("--- ")))
    named = F.when(line.startswith("diff --git "), F.regexp_extract("line", r'^diff --git "?a/.*?"? "?b/(.*?)"?$', 1))
    heads = lines.groupBy(*place).agg(last(kind).alias("_kind"), last(new).alias("_new"), last(old).alias("_old"), last(named).alias("_named"))
    files = heads.withColumn("change_type", F.coalesce("_kind", F.lit("modify")))
    files = files.withColumn("rel_path", F.when(F.col("change_type") == "delete", F.coalesce("_old", "_named")).otherwise(F.coalesce("_new", "_named", "_old")))
    counted = sided(lines).groupBy(*place, "side", "line_hash").agg(F.count("*").alias("count")).join(files.select(*place, "rel_path"), place)
    number = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("count"))), F.lit(0))
    sums = counted.groupBy(*place).agg(number("+").alias("added_lines"), number("-").alias("removed_lines"))
    sized = files.join(sums, place, "left").fillna(0, ["added_lines", "removed_lines"])
    return sized.select(*keys, "rel_path", "change_type", "added_lines", "removed_lines"), counted.groupBy(*keys, "rel_path", "side", "line_hash").agg(F.sum("count").alias("count"))


def patch_text(raw: Column) -> Column:
    """The patch of a tool call's input: as it is, a JSON string, or under `patch` or `input`."""
    text = F.trim(raw)
    as_string = F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")
    return F.when(text.startswith("*** Begin Patch"), text).when(text.startswith('"'), as_string).when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.patch"), F.get_json_object(text, "$.input")))


def apply_patch(calls: DataFrame, keys: list[str], raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations (keys, op_index, path, added_lines, removed_lines), their hashes, and errors (keys, error)."""
    texts = calls.select(*keys, patch_text(F.col(raw)).alias("_patch"))
    starts = F.col("line").rlike(r"^\*\*\* (Update|Add|Delete) File: ")
    lines = numbered(texts.filter(F.col("_patch").isNotNull()), keys, "_patch", starts)
    ended = Window.partitionBy(*keys).orderBy("line_no")
    lines = lines.filter(~F.startswith("line", F.lit("*** End of File"))).withColumn("_end", F.max(F.startswith("line", F.lit("*** End Patch")).cast("int")).over(ended)).filter("_end = 0")
    place = [*keys, BLOCK]
    path = F.coalesce(rest_of("*** Move to: "), F.when(starts, F.regexp_extract("line", r"^\*\*\* \w+ File: (.*?)\s*$", 1)))
    heads = lines.groupBy(*place).agg(F.max_by(path, F.when(path.isNotNull(), F.col("line_no"))).alias("path"))
    changed = sided(lines)
    number = lambda s: F.count(F.when(F.col("side") == s, 1))
    ops = heads.join(changed.groupBy(*place).agg(number("+").alias("added_lines"), number("-").alias("removed_lines")), place, "left").fillna(0, ["added_lines", "removed_lines"])
    indexed = lambda df: df.withColumn("op_index", F.col(BLOCK) - 1)
    hashes = indexed(changed.groupBy(*place, "side", "line_hash").agg(F.count("*").alias("count"))).select(*keys, "op_index", "side", "line_hash", "count")
    unread = texts.filter(F.col("_patch").isNull()).select(*keys, F.lit("failed to parse apply_patch input").alias("error"))
    bare = texts.filter(F.col("_patch").isNotNull()).join(heads.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("apply_patch input did not contain any file blocks").alias("error"))
    return indexed(ops).select(*keys, "op_index", "path", "added_lines", "removed_lines"), hashes, unread.unionByName(bare)


HEREDOC = r"cat\s*(>>?)\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s<>]+))\s*<<-?\s*[\"']?(\w+)[\"']?[^\n]*\n([\s\S]*?)(?<=\n)\5(?=\n|$)"


def heredocs(calls: DataFrame, keys: list[str], command: str) -> DataFrame:
    """(keys, doc_index, mode, path, content): the files that shell commands write with here-documents."""
    parts = [F.regexp_extract_all(command, F.lit(HEREDOC), F.lit(g)) for g in (1, 2, 3, 4, 6)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("mode", "a", "b", "c", "content"))])
    rows = calls.select(*keys, F.posexplode(zipped).alias("doc_index", "x"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(*keys, "doc_index", F.when(F.col("x.mode") == ">>", "append").otherwise("overwrite").alias("mode"), F.coalesce(blank("x.a"), blank("x.b"), blank("x.c")).alias("path"), F.col("x.content").alias("content"))


def heredoc_changes(docs: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """`docs` with before (the text that the session last wrote to the path, null if unknown).

    An overwrite replaces what is known; what follows it is appended, so the text before a write is
    the last overwrite and the appends since, all within one window of a session's path.
    """
    place = Window.partitionBy(*session, "path").orderBy(*order)
    runs = docs.withColumn("_run", F.sum((F.col("mode") == "overwrite").cast("int")).over(place))
    inner = Window.partitionBy(*session, "path", "_run").orderBy(*order)
    # each run's contents are gathered once; a write takes those before it, or all of the run before
    gathered = runs.groupBy(*session, "path", "_run").agg(F.array_sort(F.collect_list(F.struct(*order, "content"))).alias("_all"))
    contents = F.transform("_all", lambda x: x["content"])
    own = gathered.select(*session, "path", "_run", contents.alias("_own"))
    earlier = gathered.filter("_run > 0").select(*session, "path", (F.col("_run") + 1).alias("_run"), F.array_join(contents, "").alias("_previous"))
    joined = runs.withColumn("_rank", F.row_number().over(inner)).join(own, [*session, "path", "_run"]).join(earlier, [*session, "path", "_run"], "left")
    within = F.array_join(F.slice("_own", F.lit(1), F.col("_rank") - 1), "")
    before = F.when(F.col("mode") == "overwrite", F.col("_previous")).otherwise(F.when(F.col("_run") > 0, within))
    return joined.withColumn("before", before).drop("_run", "_rank", "_own", "_previous")
