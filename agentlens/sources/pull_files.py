"""Files of pull requests: what they remove, and whether that is all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.functions.hashing import line_hash, lines_of

PULL = ["repo_key", "pr_number"]


def removed_hashes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(PULL, rel_path, line_hash, count) and (PULL, removed_hashes_complete_flag).

    `files` are (PULL, filename, previous_filename, status, patch). A file without a patch makes its pull
    request incomplete, unless it was added; removed and renamed files count under their former name.
    """
    former = F.when(F.col("status").isin("removed", "renamed"), F.coalesce("previous_filename", "filename")).otherwise(F.col("filename"))
    lines = files.select(*PULL, former.alias("rel_path"), F.explode(lines_of(F.col("patch"))).alias("line")).filter(F.col("line").startswith("-") & ~F.col("line").startswith("---"))
    hashes = lines.groupBy(*PULL, "rel_path", line_hash(F.substring("line", 2, 1 << 30)).alias("line_hash")).agg(F.count("*").alias("count"))
    whole = F.min((F.col("patch").isNotNull() | (F.col("status") == "added")).cast("int"))
    return hashes, files.groupBy(*PULL).agg(whole.alias("removed_hashes_complete_flag"))
