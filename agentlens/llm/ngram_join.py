"""N-gram Jaccard join by vertical partitioning.

N-grams (distinct shingles of `WORDS` words, as 64-bit hashes) are put in one
global order, the order is cut into fragments, and every document is cut along
it. What happens in a fragment needs only the documents' parts there.

1. All documents. In each fragment the shingles that occur more than once are
   found, and each document's number of them is counted and summed over the
   fragments. A document of which less than `THRESHOLD` also occurs elsewhere has
   no partner. Parts travel as packed arrays of 4 bytes a shingle, so a false
   repetition is possible here, and only lets a document through.
2. What is left: documents with equal sets fall into classes (copies are never
   paired), and the rest works on classes. Their shingles are ordered by
   frequency; two classes that link share one of the first `n - ceil(3/4 n) + 1`
   of the larger and the first `n - ceil(6/7 n) + 1` of the smaller.
3. Links, first round: of the classes that share a shingle of their first, each is
   paired with the most central one (the one with the largest share of shingles
   that occur elsewhere). Second round: pairs of a larger and a smaller class that
   share such a shingle, are in different components so far and pass the bounds on
   sizes, on what can follow the shared place and on the parity bitmaps (which no
   linked pair fails). Pairs within a component need no check.
4. The order of n-grams is cut into fragments again, a pair's overlap is counted in
   each fragment apart and summed, and the pair links if 100 * intersection >=
   75 * union.

So the components are those of all links, though a group of m near copies is
not expanded into m * m pairs.

Defined cases: a null text, or one without words, has an empty set, is linked
with nothing and is its own component; a text with fewer than five words has
them as one shingle; rows with a null id have a null component, and ids below 0 are
ids like others; rows that repeat an id with other texts are one document, linked
with whatever any of them is linked with; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import LOWER, UPPER, dealt, discarded, table, text_bytes, whole_text, written
from agentlens.llm.components import components

WORDS, PERCENT = 5, 75
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) % 2**64 | 1 for i in range(WORDS)], np.uint64)
PART_BYTES = 4_000_000  # of text in one packed part
FRAGMENT_ENTRIES = 4_000_000  # with fewer, a part's documents are named in more fragments, which takes more than their shingles
BITS = 1024  # of a parity bitmap
LEAST_FRAGMENTS = 4  # in which overlaps are counted
#: Ids of documents to look at again are broadcast up to this number (8 bytes each); more join by shuffle.
BROADCAST_IDS = 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: WordHashes) -> np.ndarray:
    """The set as sorted hashes."""
    w = text.encode().translate(LOWERED).split()  # bytes split at \x20 and \x09-\x0D
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = len(h) - WORDS + 1
    if n < 1:
        return mixed(np.array([(h * PLACES[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    total = h[:n] * PLACES[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * PLACES[i]
    return np.unique(mixed(total))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about `PART_BYTES` characters; the batches have the id and the text."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= PART_BYTES or len(ids) >= 60_000:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


PACKED = pa.schema([("fragment", pa.int32()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("hashes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])


def packed_parts(rows: DataFrame, n_fragments: int) -> DataFrame:
    """The cut sets of all documents: a row for each part and fragment, and one with the part's ids and sizes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for ids, texts in parts(batches):
            sets = [shingles(t, words) for t in texts]
            sizes = np.array([len(s) for s in sets], np.int64)
            name = xxhash.xxh3_64_intdigest(np.array([-1 if i is None else i for i in ids], np.int64).tobytes() + sizes.tobytes() + b"".join(s[:1].tobytes() for s in sets)) - (1 << 63)
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            fragment = (((flat >> np.uint64(32)) * np.uint64(n_fragments)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(fragment, kind="stable")
            flat, doc, fragment = flat[order].astype(np.uint32), doc[order], fragment[order]
            out = [(int(name % n_fragments), name, ids, sizes.tobytes(), None, None)]
            for start, length in zip(*runs(fragment)):
                own = doc[start : start + length]
                first, n = runs(own)
                out.append((int(fragment[start]), name, None, flat[start : start + length].tobytes(), own[first].tobytes(), n.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), PACKED)], schema=PACKED)

    return rows.mapInArrow(pack, "fragment int, part bigint, ids array<bigint>, hashes binary, docs binary, counts binary")


COUNTED = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("docs", pa.binary()), ("counts", pa.binary())])


def count_repeated(group: pa.Table) -> pa.Table:
    """In one fragment: how many of each document's shingles occur more than once. Rows with ids pass."""
    rows = group.to_pylist()
    own = [r for r in rows if r["ids"] is None]
    out = [(r["part"], r["ids"], r["hashes"], None) for r in rows if r["ids"] is not None]
    if own:
        hashes = [np.frombuffer(r["hashes"], np.uint32) for r in own]
        every = np.sort(np.concatenate(hashes))
        starts, n = runs(every)
        repeated = every[starts[n > 1]]
        for r, h in zip(own, hashes):
            at = np.minimum(np.searchsorted(repeated, h), max(len(repeated) - 1, 0))
            flags = (repeated[at] == h) if len(repeated) else np.zeros(len(h), bool)
            lengths = np.frombuffer(r["counts"], np.uint32).astype(np.int64)
            sums = np.add.reduceat(flags.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            some = sums > 0
            out.append((r["part"], None, np.frombuffer(r["docs"], np.uint16)[some].tobytes(), sums[some].astype(np.uint32).tobytes()))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), COUNTED)], schema=COUNTED)


SUMMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("repeated", pa.int64())])


def sum_repeated(group: pa.Table) -> pa.Table:
    """Of one part: each document's size and its counts summed over the fragments."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    total = np.zeros(len(head["ids"]), np.int64)
    for r in rows:
        if r["ids"] is None:
            np.add.at(total, np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["counts"], np.uint32).astype(np.int64))
    return pa.Table.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(np.frombuffer(head["docs"], np.int64)), pa.array(total)], schema=SUMMED)


def possible(rows: DataFrame, n_fragments: int) -> DataFrame:
    """(doc_id, n, repeated) of every document."""
    counted = dealt(packed_parts(rows, n_fragments), n_fragments).groupBy("fragment").applyInArrow(count_repeated, "part bigint, ids array<bigint>, docs binary, counts binary")
    return counted.groupBy("part").applyInArrow(sum_repeated, "doc_id bigint, n bigint, repeated bigint")


def parity_bitmap(own: np.ndarray) -> np.ndarray:
    """`BITS` bits as int64s: a bit is odd or even as the number of shingles whose hash falls on it. Sets differ by as many shingles as their bitmaps by bits, or more."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sum", pa.int64()), ("xor", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, n, sum, xor, shingles, bits): whole sets, two sums that name the set, and its parity bitmap."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(ids), 500):
                own = [shingles(t, words) for t in texts[start : start + 500]]
                cols = [ids[start : start + 500], [len(s) for s in own], [int(s.sum().astype(np.int64)) if len(s) else 0 for s in own], [int(np.bitwise_xor.reduce(mixed(s)).astype(np.int64)) if len(s) else 0 for s in own], [s.view(np.int64) for s in own], [parity_bitmap(s) for s in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SETS)], schema=SETS)

    return rows.mapInArrow(sets, "doc_id bigint, n bigint, `sum` bigint, `xor` bigint, shingles array<bigint>, bits array<bigint>")


SEGMENTS = "set_id bigint, fragment int, segment array<bigint>, n bigint, `sum` bigint, `xor` bigint, representative bigint, bits array<bigint>"


def segmented(sets: DataFrame, fragments: int) -> DataFrame:
    """Sets cut along the n-gram order: a row for each fragment with shingles of the set; its first row alone also has `sum`, `xor`, representative and bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column("shingles")
            flat, lengths = shingles.flatten(), shingles.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            # a set's hashes are sorted, so those of a fragment are a run
            fragment = (((flat.to_numpy().view(np.uint64) >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)).astype(np.int64)
            starts, _ = runs(row * fragments + fragment)
            of = row[starts]
            first = pa.array(of, mask=np.concatenate([np.zeros(1, bool), of[1:] == of[:-1]])[: len(of)])
            segment = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), flat)
            cols = [batch.column("set_id").take(pa.array(of)), pa.array(fragment[starts], pa.int32()), segment, batch.column("n").take(pa.array(of)), *[batch.column(c).take(first) for c in ("sum", "xor", "representative", "bits")]]
            yield pa.RecordBatch.from_arrays(cols, names=["set_id", "fragment", "segment", "n", "sum", "xor", "representative", "bits"])

    return sets.mapInArrow(cut, SEGMENTS)


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps are counted in each fragment and summed."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("segment").alias("of_a"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("segment").alias("of_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("overlap"))
    both = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return both.filter(100 * F.col("overlap") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def segments_of(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments of the sets in `pairs`; all of them, if these are too many to broadcast."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return segments.join(F.broadcast(ids), "set_id", "left_semi") if few else segments


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes (doc_id, n) of all rows; members (doc_id, set_id, representative); links (a, b) that join up sets."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    n_fragments = max(1, text_bytes(rows) // 6 // FRAGMENT_ENTRIES)
    sizes = written(possible(rows, n_fragments))
    open_ids = sizes.filter((F.col("n") > 0) & (100 * F.col("repeated") >= PERCENT * F.col("n")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    few = open_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sets = written(shingle_sets(rows.join(F.broadcast(open_ids) if few else open_ids, "doc_id", "left_semi")))
    name = ["n", "sum", "xor"]
    fragments = max(LEAST_FRAGMENTS, n_fragments // 3)
    # equal sets travel once from each task; written, so that a set's number stays the same and a large class is split in the join with its members
    same = sets.filter("n > 0").groupBy(*name).agg(F.min("doc_id").alias("representative"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
    segments = written(segmented(same.withColumn("set_id", F.monotonically_increasing_id()), fragments))
    groups = segments.filter(F.col("representative").isNotNull())
    members = written(sets.select("doc_id", *name).join(groups.select(*name, "set_id", "representative"), name).select("doc_id", "set_id", "representative").distinct())
    discarded(sets)

    # frequencies among sets; a shingle of one set only is at the head of the order and takes no part in joins
    long = segments.select("set_id", "n", F.explode("segment").alias("shingle"))
    often = long.groupBy("shingle").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    shared = long.join(often, "shingle").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    # by whole numbers: ceil(n * 75 / 100) is exact in doubles for any size of a text
    first = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
    alone = (F.col("n") - F.size("shared")).cast("int")
    heads = written(shared.withColumn("alone", alone).withColumn("take", first - alone).filter(F.col("take") > 0).select("set_id", "n", "alone", F.transform(F.slice("shared", F.lit(1), F.col("take")), lambda x: x["shingle"]).alias("head")))

    entries = heads.select("set_id", "n", "alone", F.posexplode("head").alias("at", "shingle")).withColumn("at", F.col("at") + F.col("alone"))
    central = (F.col("n") - F.col("alone")) / F.col("n")
    hubs = entries.groupBy("shingle").agg(F.max(F.struct(central.alias("central"), -F.col("set_id"), "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("shingle", (-F.col("hub.col2")).alias("hub"), F.col("hub.n").alias("n_hub"))
    close = lambda x, y: (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))
    star = written(entries.join(hubs, "shingle").filter((F.col("set_id") != F.col("hub")) & close("n", "n_hub")).select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct())
    by_hubs = written(verified(star, segments))
    found = components(by_hubs)

    placed = entries.join(found.withColumnRenamed("vertex", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    split = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
    rest = written(placed.join(split, "shingle", "left_semi").join(groups.select("set_id", "bits"), "set_id"))
    # linked sets overlap in 3/7 of their sizes' sum or more, so in 6/7 of the smaller one, and differ by at most a seventh of the sum
    x, y = rest.filter(7 * F.col("at") <= F.col("n")).alias("x"), rest.alias("y")
    sum_of = F.col("x.n") + F.col("y.n")
    apart = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    ahead = 7 * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= 3 * sum_of  # holds where the pair first meets
    near = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.n")) & close(F.col("x.n"), F.col("y.n")) & ahead & (7 * apart <= sum_of)
    cross = x.join(y, near).select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
    pairs = written(cross.join(star, ["a", "b"], "left_anti"))
    second = written(verified(pairs, segments_of(pairs, segments)))
    discarded(segments, heads, rest, star, pairs)
    return sizes.select("doc_id", "n"), members, by_hubs.unionByName(second)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row."""
    sizes, members, links = classes(docs, key, text)
    # an id that repeats with several texts ties their sets together
    one = members.groupBy("doc_id").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("_last"))
    ties = members.join(one.filter("set_id < _last").select("doc_id", F.col("set_id").alias("a")), "doc_id").filter(F.col("a") < F.col("set_id")).select("a", F.col("set_id").alias("b"))
    found = components(links.unionByName(ties)).withColumnRenamed("vertex", "set_id")
    least = members.select("set_id", "representative").distinct().join(found, "set_id").groupBy("component").agg(F.min("representative").alias("component_id"))
    named = written(found.join(least, "component").select("set_id", "component_id"))
    own = members.select("doc_id", "set_id", "representative").join(named, "set_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "representative")).alias("component_id"))
    every = sizes.join(own, "doc_id", "left")
    return every.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op8_ngram_join": r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id"""
}
