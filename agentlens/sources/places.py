"""Where a logged path is: resolved against folders, and its repository and path within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.functions.columns import blank_to_null
from agentlens.sources.path_resolution import repository_of
from agentlens.sources.store_changes import bare_path


def unquoted(path: Column) -> Column:
    """A path without the blanks around it and one pair of quotes."""
    bare = F.trim(path)
    return F.when(bare.rlike(r"""^(".*"|'.*')$""") & (F.char_length(bare) > 1), F.substring(bare, F.lit(2), F.char_length(bare) - 2)).otherwise(bare)


def absolute(path: Column, workdir: Column, cwd: Column) -> Column:
    """A path as it is if it has a root or drive, else in the call's folder, else in the session's."""
    clean = bare_path(unquoted(path))
    rooted = clean.startswith("/") | clean.rlike(r"^[A-Za-z]:[\\/]")
    folder = F.coalesce(workdir, cwd)
    return F.when(rooted | folder.isNull(), clean).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), clean))


def slashed(path: Column) -> Column:
    """One form for a path: no scheme, forward slashes, a drive in lower case, no empty or `.` steps; `..` takes back the step before it."""
    forward = F.regexp_replace(bare_path(path), r"\\", "/")
    drive = F.lower(F.regexp_extract(forward, "^/?([A-Za-z]:)/", 1))
    rest = F.when(drive != "", F.regexp_replace(forward, "^/?[A-Za-z]:", "")).otherwise(forward)
    steps = F.filter(F.split(rest, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    root = F.when(drive != "", F.concat(drive, F.lit("/"))).when(forward.startswith("/"), "/").otherwise("")
    return F.concat(root, F.array_join(walked, "/"))


def located(rows: DataFrame, repos: DataFrame, path: str = "path", workdir: str = "workdir", cwd: str = "cwd") -> DataFrame:
    """`rows` with abs_path, repo_root and rel_path; the last two are null outside of all repositories."""
    told = rows.withColumn("abs_path", slashed(absolute(F.col(path), blank_to_null(F.col(workdir)), blank_to_null(F.col(cwd)))))
    roots = repository_of(told.select(F.col("abs_path").alias("path")), repos).withColumnRenamed("path", "abs_path")
    within = F.when(F.col("repo_root").isNotNull(), F.substr("abs_path", F.char_length("repo_root") + 2))
    return told.join(roots, "abs_path", "left").withColumn("rel_path", within)


def history_entries(files: DataFrame) -> DataFrame:
    """(folder, path, id, source, timestamp) of `entries.json` texts (folder, value): the versions that an editor keeps of a file."""
    kind = "struct<resource:string,entries:array<struct<id:string,source:string,timestamp:bigint>>>"
    read = files.select("folder", F.from_json("value", kind).alias("_read")).filter("_read.resource IS NOT NULL")
    each = read.select("folder", bare_path(F.col("_read.resource")).alias("path"), F.explode("_read.entries").alias("e")).filter("e.id IS NOT NULL")
    return each.select("folder", "path", "e.id", F.coalesce("e.source", F.lit("")).alias("source"), F.coalesce("e.timestamp", F.lit(0)).cast("bigint").alias("timestamp"))


def read_history(spark, root: str) -> DataFrame:
    """(path, id, source, timestamp, content) of a local history: a folder for each file, with `entries.json` and a text for each version."""
    name = F.col("_metadata.file_path")
    every = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.substring_index(name, "/", -1).alias("id"), F.regexp_replace(name, "/[^/]*$", "").alias("folder"), "value")
    entries = history_entries(every.filter("id = 'entries.json'"))
    return entries.join(every.withColumnRenamed("value", "content"), ["folder", "id"], "left").select("path", "id", "source", "timestamp", F.coalesce("content", F.lit("")).alias("content"))
