"""Logs as a stream: new files are parsed by the same functions as in batch, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agentlens.functions.columns import is_error_paste
from agentlens.sources.files import in_order, numbered_lines, raw_lines


def new_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as they appear; the checkpoint remembers the files that have been read."""
    return raw_lines(spark.readStream, path)


def ingest(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Numbers and parses each batch of files and appends its rows to a Parquet table; a batch that is tried again replaces its own part.

    A batch's lines are held until its rows are written; those that an executor takes with it are read again, by the same pieces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = in_order(batch).persist(StorageLevel.DISK_ONLY)
        try:
            parse(numbered_lines(held)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        finally:
            held.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_error_pastes(messages: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(provider, window, n_messages, n_pastes): pasted errors by session windows of activity; late rows within the watermark count."""
    users = messages.filter("role = 'user'").withWatermark("message_ts", late)
    counts = users.groupBy("provider", F.session_window("message_ts", gap).alias("window")).agg(F.count("*").alias("n_messages"), F.sum(is_error_paste(F.col("content")).cast("bigint")).alias("n_pastes"))
    return counts.select("provider", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_messages", "n_pastes")
