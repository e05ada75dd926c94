"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.operators.tables import discarded, written

__all__ = ["LOWER", "UPPER", "ascii_lower", "dealt", "discarded", "table", "text_bytes", "whole_text", "without_ids", "written"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions of an exchange at most; beyond it a partition takes several fragments, one after another.
MOST_PARTITIONS = 100_000


def dealt(df: DataFrame, n_fragments: int, fragment: str = "fragment") -> DataFrame:
    """`df` with one fragment to a partition, however many there are: hashed, some partitions would take several and most none."""
    return df.repartitionById(min(n_fragments, MOST_PARTITIONS), fragment)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_text(c: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def text_bytes(docs: DataFrame, c: str = "text") -> int:
    """Bytes of all texts; one cheap scan of one column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("n")).first()["n"]


#: Ids up to this number are broadcast (8 bytes each); more join by shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose id is among `ids`; rows with a null id stay."""
    gone = written(ids.select(key).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")
