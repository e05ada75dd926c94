"""Event tables on disk, by repository and week, of which a refresh replaces the partitions that changed.

A refresh is one job that writes beside the table and moves its partitions when all of them are complete, so a job that
fails or is lost leaves the table as it was. A partition that has no rows any more gets a marker instead, which readers
leave out: it has to be replaced as well, or the old rows would stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.functions.columns import week_start

PART = ["_repo", "_week"]


def keyed(rows: DataFrame, time: str) -> DataFrame:
    """`rows` with their partition; unknown repositories and times have one of their own."""
    return rows.withColumns({"_repo": F.col("repo_root"), "_week": week_start(F.col(time)).cast("string")})


class EventStore:
    """Event tables in a folder. `time` is the column that a table's weeks are of."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def build(self, name: str, rows: DataFrame, time: str) -> None:
        """The whole table anew."""
        self._write(name, keyed(rows, time).withColumn("_row", F.lit(True)), "static")

    def refresh(self, name: str, rows: DataFrame, time: str, changed: DataFrame) -> None:
        """Replaces the partitions of `changed` (repo_root, `time`) by what `rows` have of them; `rows` may have more."""
        wanted = keyed(changed.select("repo_root", time), time).select(*PART).distinct()
        same = lambda a, b: a["_repo"].eqNullSafe(b["_repo"]) & a["_week"].eqNullSafe(b["_week"])
        all_rows = keyed(rows, time)
        own = all_rows.join(wanted, same(all_rows, wanted), "left_semi").withColumn("_row", F.lit(True))
        present = own.select(*PART).distinct()
        empty = wanted.join(present, same(wanted, present), "left_anti").withColumn("_row", F.lit(False))
        self._write(name, own.unionByName(empty, allowMissingColumns=True), "dynamic")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).filter("_row").drop("_row", *PART)

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        # a task writes few partitions, and a partition's rows come in few files, of any number of tasks
        dealt = rows.hint("rebalance", *PART)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*PART).parquet(self.path(name))
