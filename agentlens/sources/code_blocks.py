"""Changes of code blocks of older sessions, rung by rung, and what a session's lines come from where no tool told them.

A code block's own diff tells its lines; where there is none or it can't be read, its text against the text before it
does; and where a session has only one file left that neither could tell, the session's totals are that file's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlens.functions.hashing import with_line_diff
from agentlens.operators.tables import written
from agentlens.sources.kv_store import by_priority
from agentlens.sources.store_changes import history_lines

FILE = ["session_id", "path"]
HUNKS = "array<struct<modified:array<string>>>"
SIDES = (("removed", "originalModelDiffWrtV0"), ("added", "newModelDiffWrtV0"))


def payload_lines(value: Column, field: str) -> Column:
    """The lines of all hunks of a side; null if the payload has no list of them."""
    hunks = F.get_json_object(value, f"$.{field}")
    lines = F.flatten(F.transform(F.from_json(hunks, HUNKS), lambda h: F.coalesce(h["modified"], F.array().cast("array<string>"))))
    return F.when(hunks.startswith("["), lines)


def block_changes(targets: DataFrame, payloads: DataFrame, seen: DataFrame, totals: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, path, version, idx, rung, lines_added, lines_removed) of code blocks, and (session_id, path, error) of files that no rung tells.

    `targets` are (session_id, path, diff_id, content, version, idx), `payloads` (session_id, diff_id, value), `seen`
    (session_id, path) have their changes from elsewhere, `totals` are (session_id, lines_added, lines_removed) and
    `originals` (session_id, path) the files of which a session has an original state. An error counts if nothing after it
    tells the file; totals only stand for a file with an original state that nothing tells, and only if it is the only one.
    """
    order = Window.partitionBy(*FILE).orderBy("version", "idx", F.coalesce("diff_id", F.lit("")))
    placed = targets.withColumn("_seq", F.row_number().over(order)).withColumn("_before", F.last("content", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = placed.join(seen.select(*FILE).distinct(), FILE, "left_anti")
    read = payloads.select("session_id", "diff_id", *[payload_lines(F.col("value"), field).alias(name) for name, field in SIDES], F.lit(1).alias("_there"))
    met = fresh.join(read, ["session_id", "diff_id"], "left")
    missing = F.coalesce(*[F.when(F.col(name).isNull(), F.lit(f"the diff has no list of {field}")) for name, field in SIDES])
    error = F.when(F.col("diff_id").isNull(), None).when(F.col("_there").isNull(), "the diff of the code block is missing").otherwise(missing)
    told = F.col("diff_id").isNotNull() & error.isNull() & (F.size("added") + F.size("removed") > 0)
    texts = F.col("_before").isNotNull() & F.col("content").isNotNull() & ~told
    # only texts that stand in for a diff are compared
    compared = with_line_diff(
        met.withColumns({"_error": error, "_told": told, "_from": F.when(texts, F.col("_before")), "_to": F.when(texts, F.col("content"))}).withColumnsRenamed({"added": "_added", "removed": "_removed"}).drop("_before", "content"), "_from", "_to"
    )
    rung = F.when(F.col("_told"), "diff").when(F.col("added") + F.col("removed") > 0, "content")
    number = lambda own, text: F.when(F.col("_told"), F.size(own)).otherwise(F.col(text)).cast("bigint")
    steps = written(compared.select(*FILE, "version", "idx", "_seq", "_error", rung.alias("rung"), number("_added", "added").alias("lines_added"), number("_removed", "removed").alias("lines_removed")))
    last = steps.filter("rung IS NOT NULL").groupBy(*FILE).agg(F.max("_seq").alias("_last"))
    failed = steps.filter("_error IS NOT NULL AND rung IS NULL").join(last, FILE, "left").filter("_last IS NULL OR _seq > _last")
    errors = written(failed.groupBy(*FILE, "_last").agg(F.min_by("_error", "_seq").alias("error")))
    alone = errors.groupBy("session_id").agg(F.count("*").alias("_n")).filter("_n = 1").select("session_id")
    only = errors.filter("_last IS NULL").join(alone, "session_id", "left_semi").join(originals.select(*FILE).distinct(), FILE, "left_semi")
    from_totals = only.join(totals, "session_id").filter("lines_added > 0 OR lines_removed > 0").select(*FILE, F.lit(None).cast("int").alias("version"), F.lit(None).cast("int").alias("idx"), F.lit("totals").alias("rung"), "lines_added", "lines_removed")
    changes = steps.filter("rung IS NOT NULL").select(*FILE, "version", "idx", "rung", "lines_added", "lines_removed").unionByName(from_totals)
    return changes, errors.join(from_totals, FILE, "left_anti").select(*FILE, "error")


def session_lines(tool_edits: DataFrame, wanted: DataFrame, history: DataFrame, totals: DataFrame) -> DataFrame:
    """(session_id, path, lines_added, lines_removed, stage) of each session, from the first source that has any rows for it.

    The sources are tool edits, the local history of the files that its code blocks name (`wanted`: session_id, path,
    begin_ms, end_ms; files without history have no lines but count), and the session's totals under the path `__total__`.
    """
    columns = [*FILE, "lines_added", "lines_removed"]
    files = wanted.select(*FILE).distinct()
    told = files.join(history_lines(history, wanted), FILE, "left").fillna(0, ["lines_added", "lines_removed"])
    whole = totals.filter("lines_added IS NOT NULL AND lines_removed IS NOT NULL AND (lines_added > 0 OR lines_removed > 0)").withColumn("path", F.lit("__total__"))
    return by_priority([df.select(*columns) for df in (tool_edits, told, whole)], ["session_id"])
