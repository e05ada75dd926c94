"""Ranked lexical search with block-max pruning over a forward index.

`build_index` writes the documents in the order in which they are read as blocks of
`BLOCK_DOCS` of them (or fewer, with at most about `BLOCK_TERMS` distinct terms in each):
a block has a table of its terms, with the number of its documents that hold each and
the largest impact that it has in one of them, and a forward index, each document's
terms by their number in that table with their counts.

`search` bounds a block's score for an item by the sum of its terms' weights times
their maxima. Blocks are scored in the order of their bounds: first, for each item, the
`FIRST_BLOCKS` blocks of the whole index with the largest bounds, which gives a threshold
that the last of the best `k` reaches; then every task goes through its blocks, in
groups, from the largest bound down until it is below the threshold, which rises with
what the task has found. No block whose bound reaches the threshold is left out, so the
result is exact. All arithmetic is on whole numbers, products as float64 only where
they stay below 2**53.

Items are a stated query set, searched in lots of bounded size, each against all blocks:
only a lot travels to the tasks, and a task returns `k` documents an item at most.

Defined cases: a null text has no terms and a document without terms isn't counted; an
item without terms, or none of whose terms occurs, finds nothing; rows of the items'
table are items each, also where they repeat an id or have none; rows that repeat a
document's id are documents each; documents without an id count and are found, after
others of the same score; a very long text is a block of its own; an empty table finds
nothing; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from agentlens.llm.common import table, whole_text, written

BLOCK_DOCS, BLOCK_TERMS = 64, 100_000
FIRST_BLOCKS = 4
#: Items of a lot and their terms, at most; an item with more terms is a lot of its own. A task holds a matrix of terms by items.
LOT_ITEMS, LOT_TERMS = 256, 40_000
#: Blocks that a task holds at once, and bytes of a row group of the index, which is decoded as a whole.
GROUP_BLOCKS, ROW_GROUP = 8, str(4 << 20)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8 a term is a run of ASCII letters, digits and bytes of other characters; all else becomes a blank.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = pa.schema(
    [("block", pa.int64()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("maxima", pa.list_(pa.int64()))]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)
INDEX_SQL = "block bigint, terms array<string>, dfs array<int>, maxima array<bigint>, doc_ids array<bigint>, lengths array<bigint>, starts array<int>, numbers array<int>, counts array<int>"
FOUND_SQL = "item bigint, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000*tf) div (1000*tf+20*m), row by row; in Python's numbers, once a distinct length, where 64 bits may not do."""
    kinds, at = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * int(n) * n_docs // n_terms for n in kinds], np.int64)[at]
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The written index, the number of documents with terms and the number of all their terms."""
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for t in batch.column(0) if (n := len(terms(t.as_py())))]
            yield pa.RecordBatch.from_pydict({"docs": [len(found)], "terms": [sum(found)]})

    sizes = rows.select("_text").mapInArrow(size, "docs bigint, terms bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms"))).first()
    n_docs, n_terms = sizes["docs"], sizes["terms"]

    def block_row(name: int, held: list[tuple[int | None, Counter, int]]) -> dict:
        table_of: dict[bytes, int] = {}
        numbers = np.array([table_of.setdefault(t, len(table_of)) for _, c, _ in held for t in c], np.int32)
        counts = np.array([n for _, c, _ in held for n in c.values()], np.int32)
        sizes = [len(c) for _, c, _ in held]
        maxima = np.zeros(len(table_of), np.int64)
        np.maximum.at(maxima, numbers, impacts(counts, np.repeat([n for _, _, n in held], sizes), n_docs, n_terms))
        return {
            "block": name, "terms": [t.decode() for t in table_of], "dfs": np.bincount(numbers, minlength=len(table_of)).astype(np.int32), "maxima": maxima,
            "doc_ids": [i for i, _, _ in held], "lengths": [n for _, _, n in held], "starts": np.cumsum([0, *sizes], dtype=np.int32), "numbers": numbers, "counts": counts,
        }

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, Counter, int]] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(t.as_py())
                if found:
                    own = Counter(found)
                    if held and (len(held) >= BLOCK_DOCS or size + len(own) > BLOCK_TERMS):
                        yield pa.RecordBatch.from_pylist([block_row(name, held)], schema=INDEX)
                        held, size, name = [], 0, name + 1
                    held.append((i, own, len(found)))
                    size += len(own)
        if held:
            yield pa.RecordBatch.from_pylist([block_row(name, held)], schema=INDEX)

    return written(rows.mapInArrow(build, INDEX_SQL), **{"parquet.block.size": ROW_GROUP}), n_docs, n_terms


class Lot:
    """Some items' terms as columns of a matrix: a row for each distinct term, a column for each item, weights in the cells."""

    def __init__(self, items: list[tuple[int, dict[str, int]]]):
        self.items = np.array([i for i, _ in items], np.int64)
        self.row = {t: n for n, t in enumerate(dict.fromkeys(t for _, weights in items for t in weights))}
        # an impact is below 10**6
        exact = max((sum(w.values()) for _, w in items), default=0) * 10**6 < 2**53
        self.weights = np.zeros((len(self.row), len(items)), np.float64 if exact else np.int64)
        for column, (_, weights) in enumerate(items):
            for t, w in weights.items():
                self.weights[self.row[t], column] = w

    def found_in(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the block's terms that the lot has, and their rows in the lot."""
        row = self.row
        pairs = [(n, row[t]) for n, t in enumerate(block["terms"]) if t in row]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def bounds(self, block: dict) -> np.ndarray:
        own, rows = self.found_in(block)
        return (np.asarray(block["maxima"])[own].astype(self.weights.dtype) @ self.weights[rows]).astype(np.int64)

    def scores(self, block: dict, wanted: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """Of the block's documents for the wanted items: a row for each document."""
        own, rows = self.found_in(block)
        sizes = np.diff(block["starts"])
        of_doc, numbers = np.repeat(np.arange(len(sizes)), sizes), np.asarray(block["numbers"])
        place = np.full(len(block["terms"]), -1, np.int64)
        place[own] = np.arange(len(own))
        hit = place[numbers] >= 0
        dense = np.zeros((len(sizes), len(own)), self.weights.dtype)
        dense[of_doc[hit], place[numbers[hit]]] = impacts(np.asarray(block["counts"])[hit], np.asarray(block["lengths"])[of_doc[hit]], n_docs, n_terms)
        return (dense @ self.weights[rows][:, wanted]).astype(np.int64)


class Best:
    """The best documents of an item so far, by score and then by id; rows without an id come last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.scores, self.ids, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        new = scores >= self.least
        if new.any():
            scores, ids, none = (np.concatenate(x) for x in ((self.scores, scores[new]), (self.ids, ids[new]), (self.none, none[new])))
            order = np.lexsort((ids, none, -scores))[: self.k]
            self.scores, self.ids, self.none = scores[order], ids[order], none[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def scored(lot: Lot, k: int, least: dict[int, int], n_docs: int, n_terms: int):
    """A task's work: the best `k` documents of its blocks for each item of the lot, blocks by falling bound, down to the threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, least.get(int(i), 1)) for i in lot.items]
        for blocks in groups(batches):
            bounds = np.array([lot.bounds(b) for b in blocks])
            for n in np.argsort(-bounds.max(axis=1, initial=0), kind="stable"):
                wanted = np.flatnonzero(bounds[n] >= [b.least for b in best])
                if len(wanted):
                    found = lot.scores(blocks[n], wanted, n_docs, n_terms)
                    none = np.array([i is None for i in blocks[n]["doc_ids"]])
                    ids = np.array([i or 0 for i in blocks[n]["doc_ids"]], np.int64)
                    for column, item in enumerate(wanted):
                        best[item].add(found[:, column], ids, none)
        for item, b in zip(lot.items, best):
            if len(b.ids):
                ids = pa.array(b.ids, pa.int64(), mask=b.none)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), item)), ids, pa.array(b.scores)], names=["item", "doc_id", "score"])

    return score


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Some blocks at a time, with their lists as arrays."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            held.append({n: values(n, c[i]) for n, c in zip(batch.schema.names, batch.columns)})
            if len(held) == GROUP_BLOCKS:
                yield held
                held = []
    if held:
        yield held


def values(name: str, cell):
    return cell.as_py() if name in ("block", "terms", "doc_ids") else cell.values.to_numpy()


def bounded(lot: Lot):
    """A task's work: for each item, its blocks with the largest bounds."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tops = np.empty(0, np.int64), np.empty((0, len(lot.items)), np.int64)
        for blocks in groups(batches):
            names = np.concatenate([names, np.array([b["block"] for b in blocks], np.int64)])
            tops = np.concatenate([tops, np.array([lot.bounds(b) for b in blocks])])
            if len(names) > 4 * FIRST_BLOCKS * max(8, len(lot.items)):
                names, tops = largest(names, tops)
        for column, item in enumerate(lot.items):
            order = np.lexsort((names, -tops[:, column]))[:FIRST_BLOCKS]
            order = order[tops[order, column] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), item, np.int64)), pa.array(names[order]), pa.array(tops[order, column])], names=["item", "block", "bound"])

    return bound


def largest(names: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the blocks that are among the first for an item."""
    rows = np.unique(np.argsort(-tops, axis=0, kind="stable")[:FIRST_BLOCKS])
    return names[rows], tops[rows]


def best_of_each(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last(rows.columns[1]))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lots(items: DataFrame) -> Iterator[list[tuple[int, dict[str, int]]]]:
    """The items' weighted terms, one lot after another; items without terms that occur are left out."""
    held: list[tuple[int, dict[str, int]]] = []
    size = 0
    for r in items.toLocalIterator():
        if held and (len(held) == LOT_ITEMS or size + len(r["terms"]) > LOT_TERMS):
            yield held
            held, size = [], 0
        held.append((r["item"], dict(r["terms"])))
        size += len(r["terms"])
    if held:
        yield held


def weighted_items(items: DataFrame, index: DataFrame, n_docs: int, text: str) -> DataFrame:
    """(item, terms): each item's distinct terms that occur, with their weights."""
    lowered = F.translate(whole_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item", F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
    wanted = written(asked.select("term").distinct())
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weights = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    return asked.join(weights, "term").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))


def search(items: DataFrame, docs: DataFrame, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", text: str = "text", k: int = 50) -> DataFrame:
    """(item_key, rank, key, score): the `k` documents with the highest scores for each row of `items`."""
    index, n_docs, n_terms = build_index(docs, key, text)
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("_name"), F.col(item_text).alias("_text")))
    weighted = written(weighted_items(numbered, index, n_docs, "_text"))
    found: DataFrame | None = None
    for some in lots(weighted):
        lot = Lot(some)
        tops = index.select("block", "terms", "maxima").mapInArrow(bounded(lot), "item bigint, block bigint, bound bigint")
        first = written(best_of_each(tops, "bound", FIRST_BLOCKS).select("block").distinct())  # FIRST_BLOCKS an item at most
        at_first = index.join(F.broadcast(first), "block", "left_semi").mapInArrow(scored(lot, k, {}, n_docs, n_terms), FOUND_SQL)
        least = best_of_each(at_first, "score", k).filter(F.col("rank") == k).select("item", "score").collect()
        own = index.mapInArrow(scored(lot, k, {r["item"]: r["score"] for r in least}, n_docs, n_terms), FOUND_SQL)
        own = written(best_of_each(own, "score", k))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = numbered.select("item", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("rank")).limit(0)
    return found.join(numbered.select("item", "_name"), "item").select(F.col("_name").alias(item_key), "rank", F.col("doc_id").alias(key), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


SQL = {
    "op12_lexical_search": """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
    g AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
    s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM g),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM g) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
    p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nd) // l)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL HAVING score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 50
    """
}
