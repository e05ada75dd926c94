"""Connected components of a link table, by large-star and small-star steps.

Each step is a group-by and a join; links shrink towards stars, and a vertex
whose links are many is an ordinary join key. A step's table is written to the
shared folder, so the lineage stays short. Nothing but a count and a checksum
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import written

MOST_STEPS = 100  # far above the logarithm of any table's size; beyond it the job fails instead of giving half a result


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b): each vertex's neighbours are linked to the smallest of them and itself."""
    pairs = links.select("a", "b")
    if large:
        pairs = pairs.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = pairs.join(least, "a")
    moved = moved.filter(F.col("b") > F.col("a")) if large else moved.filter(F.col("b") != F.col("m"))
    own = least.filter(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))
    new = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (new.unionByName(own) if not large else new).filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, component): for every vertex of the links (a, b), the smallest vertex that it reaches."""
    now = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
    before = sign(now)
    for _ in range(MOST_STEPS):
        now = written(stars(stars(now, large=True), large=False))
        after = sign(now)
        if after == before:
            roots = now.select(F.col("b").alias("vertex")).distinct()
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("vertex")))
        before = after
    raise RuntimeError("components: no fixed point")
