"""Log files as rows: (source_file, mtime, size), and their lines (source_file, line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from agentlens.operators.tables import written

LOGS = "*.jsonl"


def log_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = LOGS) -> DataFrame:
    """A row for each log file below a path; the files are listed, not read. Empty ones have no row, as in any read of files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return listed.select(F.col("_metadata.file_path").alias("source_file"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))


def raw_lines(reader: DataFrameReader | DataStreamReader, path: str, recursive: bool = True, pattern: str = LOGS) -> DataFrame:
    """(source_file, _piece, value): every line, with the offset of the piece of its file that a task reads it from."""
    text = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_piece"), "value")


def in_order(raw: DataFrame) -> DataFrame:
    """`raw` with _at, which rises from line to line of a piece without a gap. Only right on lines as they are read."""
    return raw.withColumn("_at", F.monotonically_increasing_id())


def numbered_lines(held: DataFrame) -> DataFrame:
    """(source_file, line_no, value) of `in_order` lines that are held, so that both reads of them agree; blank lines count but are left out.

    A file of any size is read in pieces by many tasks: its pieces are counted, a running sum
    over them gives the number of each one's first line, and no task holds or sorts a file.
    """
    pieces = held.groupBy("source_file", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select("source_file", "_piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = held.filter(F.trim("value") != "").join(shift, ["source_file", "_piece"])
    return joined.select("source_file", (F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def log_lines(spark: SparkSession, path: str, recursive: bool = True, pattern: str = LOGS) -> DataFrame:
    """The lines of the log files below a path, numbered from 0 in each file."""
    return numbered_lines(written(in_order(raw_lines(spark.read, path, recursive, pattern))))


def file_stem(path):
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
