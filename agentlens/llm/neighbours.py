"""Approximate nearest neighbours by collision counting.

Every vector is scaled to length 1, so that the largest cosine is the smallest
distance, and is projected on `PROJECTIONS` random lines, drawn as orthonormal
bases: lines at right angles tell more about a distance than as many independent
ones. The vectors are dealt
into blocks by a hash of their id; a block keeps, for each line, the array of
its projections in order. A query opens a window around its own projection on
each line and widens all windows step by step (virtual rehashing: each step is
a coarser bucket width, without a new table). A vector that lies in the windows
of `THRESHOLD` lines collides often enough to be verified by its exact cosine.
Windows stop widening when the block has `least_verified` such vectors; all of
them are verified, none is left out. Each block returns its nearest few, and
the best of all blocks are the answer.

Queries meet blocks as (block, chunk of queries) groups of bounded size; the
index covers every row. Vectors that are null, empty, zero or hold a null or
non-finite component take no part. Only vectors of one length are compared.
Defined cases: components may be of any finite size; ties go to the smaller id, equal vectors have equal scores;
repeated rows of one id are one candidate if their vectors are equal; a row with a
null id takes no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlens.llm.common import table

PROJECTIONS, THRESHOLD = 64, 54
SEED = 20
BLOCK_ROWS, CHUNK_ROWS = 12_000, 20_000  # 10 MB of queries to a block at once, so that a block is sorted anew only for as many
WIDTHS = tuple(0.1 * 1.15**n for n in range(24))  # of windows, on unit vectors; the last holds everything
VERIFIED_SHARE, VERIFIED_LEAST = 0.03, 100


def exact_cosine(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Row by row in the same order of operations, so equal rows have equal scores wherever they stand."""
    return (rows * query).sum(axis=1) / (norms * norm)


def random_lines(size: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    bases = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS]


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(rows[order])
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.lines = random_lines(rows.shape[1])
        placed = (self.rows / self.norms[:, None]) @ self.lines
        self.order = np.argsort(placed, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(placed, axis=0).T.copy()
        self.least_verified = max(VERIFIED_LEAST, int(VERIFIED_SHARE * len(ids)))

    def frequent(self, place: np.ndarray) -> np.ndarray:
        """Row numbers of the vectors that collide with a query on `THRESHOLD` lines or more."""
        n = len(self.ids)
        counts = np.zeros(n, np.int16)
        low = high = np.array([np.searchsorted(s, p) for s, p in zip(self.sorted, place)])
        for width in WIDTHS:
            new_low = np.array([np.searchsorted(s, p - width) for s, p in zip(self.sorted, place)])
            new_high = np.array([np.searchsorted(s, p + width, side="right") for s, p in zip(self.sorted, place)])
            fresh = [o[a:b] for o, a, b in zip(self.order, new_low, low)] + [o[a:b] for o, a, b in zip(self.order, high, new_high)]
            counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
            low, high = new_low, new_high
            found = np.flatnonzero(counts >= THRESHOLD)
            if len(found) >= min(self.least_verified, n):
                return found
        return np.arange(n)

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        norm = float(np.sqrt((query[None, :] * query[None, :]).sum(axis=1))[0])
        rows = self.frequent((query / norm) @ self.lines)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:  # too few are left beside the query's own rows
            rows = np.flatnonzero(self.ids != query_id)
        scores = exact_cosine(self.rows[rows], self.norms[rows], query, norm)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(self.ids[rows[i]]), float(scores[i])) for i in best]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows, each scaled so that its largest component is between 0.5 and 1; a cosine doesn't depend on it."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    # by a power of two, which changes no digit: squares of very large or small components would leave the range
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None]) if rows.size else rows


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    real = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("_v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("bigint").alias("_id"), v.alias("_v")).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & real & some)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest found for each row of `queries`."""
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    n, n_asked = rows.count(), asked.count()
    n_blocks, n_chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // CHUNK_ROWS))
    deal = lambda name, count, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(count)).cast("int").alias(name)
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    size = F.size("_v").alias("_size")
    left = rows.select("_id", "_v", size, deal("_block", n_blocks, 1), every("_chunk", n_chunks))
    right = asked.select("_id", "_v", size, deal("_chunk", n_chunks, 2), every("_block", n_blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(own: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if own.num_rows and wanted.num_rows:
            block = Block(own["_id"].to_numpy(), matrix(own["_v"]))
            for query_id, query in zip(wanted["_id"].to_pylist(), matrix(wanted["_v"])):
                found += [(query_id, i, s) for i, s in block.nearest(query_id, query, k)]
        return pa.Table.from_pydict({f.name: [x[i] for x in found] for i, f in enumerate(schema)}, schema=schema)

    keys = ["_size", "_block", "_chunk"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
