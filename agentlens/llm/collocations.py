"""Phrase collocations, mined level by level.

The words of every language are counted, then pairs, and so on to phrases of five
words. A level starts from the frequent phrases of the one before: a filter of their
hashes goes to all tasks, and a task emits a phrase of k words only where both phrases
of k-1 words in it pass the filter. The filter is a bitmap of about `BITS_EACH` bits for
each frequent phrase and of `MOST_BITS` at most, so what is broadcast is bounded at every
size; a hash that passes by chance only lets a phrase be counted that isn't frequent, and
the counts, by the phrases themselves, are exact. Tasks add up the phrases of a block of
texts before they leave it. Scores come from joins of a candidate's cuts with the level
tables, in whole numbers of 38 digits.

A candidate is dropped if a phrase that holds it is as frequent as `share` per cent of
it; phrases between the two are at least as frequent as the longer one, so those with
one word more tell.

Defined cases: a null text is empty, an empty language name is a language; a null language
is `und`; rows that repeat count each; a null id doesn't matter, as ids aren't used; a
very long text is counted in parts that overlap by less than a phrase; ties of score go
by frequency and then by the phrase's bytes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text, written

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
#: Words that a task counts at once.
BLOCK_WORDS = 1_000_000
#: Rows of a language in a task while its first are sought, times the number sought.
ROUND = 50
#: In UTF-8: capitals lower-cased, ends of pieces to `END`, tabs to blanks.
END = b"."
BYTES = bytes(c + 32 if 65 <= c <= 90 else END[0] if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def words(text: str) -> list[bytes]:
    """The words of a text in order, with `END` between pieces."""
    return text.encode().translate(BYTES).replace(END, b" . ").split()


def hashes_of(words: list[bytes], lang: str) -> np.ndarray:
    seed, digest = xxhash.xxh64_intdigest(lang), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def chained(first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of `k` words that start at each place, from the words' hashes."""
    h = first[: len(first) - k + 1].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * FACTOR + first[j : len(first) - k + 1 + j]
    return h ^ (h >> np.uint64(31))


class Filter:
    """A bitmap of hashes."""

    def __init__(self, bits: int, places: np.ndarray, masks: np.ndarray):
        self.last = np.uint64(bits - 1)
        self.cells = np.zeros(bits // 64, np.uint64)
        self.cells[places] = masks

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes & self.last
        return (self.cells[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def filter_of(phrases: DataFrame, k: int, n: int) -> Filter:
    """Of `n` frequent phrases; the driver gets at most a cell for each and `MOST_BITS` / 64 of them, added up by the tasks."""
    bits = min(max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()), MOST_BITS)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([chained(hashes_of(p.encode().split(b" "), lang), k)[0] for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.uint64)
            h &= np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["place", "mask"])

    rows = phrases.select("lang", "phrase").mapInArrow(cells, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Filter(bits, rows["place"].to_numpy(), rows["mask"].to_numpy().view(np.uint64))


def counted_phrases(lang: str, tokens: list[bytes], k: int, passing: Filter | None) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of `k` words in `tokens`, of which both parts pass, and how often each occurs."""
    names = list(dict.fromkeys([END, *tokens]))
    codes = np.fromiter(map(dict(zip(names, range(len(names)))).__getitem__, tokens), np.int64, len(tokens))
    text = pa.array(names, pa.binary()).cast(pa.string())
    if k == 1:
        counts = np.bincount(codes, minlength=len(names))
        return text[1:], counts[1:]
    if len(codes) < k:
        return text[:0], np.empty(0, np.int64)
    hashes = hashes_of(names, lang)[codes]
    inside = codes != 0
    whole = inside[: len(codes) - k + 1].copy()
    for j in range(1, k):
        whole &= inside[j : len(codes) - k + 1 + j]
    part = passing.has(chained(hashes, k - 1))
    starts = np.flatnonzero(whole & part[:-1] & part[1:])
    # a number for each distinct phrase of two words, then of three, ..., so that the next word always fits in 64 bits
    number, told = codes[starts], []
    for j in range(1, k):
        both = number * len(names) + codes[starts + j]
        distinct, counts = np.unique(both, return_counts=True)
        told.append(distinct)
        number = np.searchsorted(distinct, both) if j < k - 1 else None
    last, parts = told[-1], []
    for _ in told:
        parts.append(text.take(pa.array(last % len(names))))
        first = last // len(names)
        last = told[len(told) - len(parts) - 1][first] if len(parts) < len(told) else first
    return pc.binary_join_element_wise(text.take(pa.array(last)), *reversed(parts), " "), counts


def level(docs: DataFrame, k: int, passing: Filter | None) -> DataFrame:
    """(lang, phrase, f): how often each phrase of `k` words occurs; for words also the row of the empty phrase, with the number of all words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(passing)

    def block(lang: str, tokens: list[bytes]) -> pa.RecordBatch:
        phrases, counts = counted_phrases(lang, tokens, k, sent.value)
        if k == 1 and len(counts):
            phrases, counts = pa.concat_arrays([phrases, pa.array([""])]), np.append(counts, counts.sum())
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), phrases, pa.array(counts, pa.int64())], schema=COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                for at in range(0, len(found), BLOCK_WORDS):
                    part = found[at : at + BLOCK_WORDS + k - 1]  # phrases start at `BLOCK_WORDS` places of it
                    held.setdefault(lang, []).extend([*part, END])
                    size += len(part) + 1
                    if size >= BLOCK_WORDS:
                        yield from (block(*own) for own in held.items())
                        held, size = {}, 0
        yield from (block(*own) for own in held.items())

    rows = docs.mapInArrow(count, "lang string, phrase string, f bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def level_tables(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """The number of words of each language, and the written table of frequent phrases of each length."""
    counts = written(level(docs, 1, None).filter((F.col("f") >= least) | (F.col("phrase") == "")))
    totals = counts.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    tables = [counts.filter((F.col("phrase") != "") & (F.col("f") >= least))]
    for k in range(2, longest + 1):
        n = tables[-1].count()
        tables.append(written(level(docs, k, filter_of(tables[-1], k - 1, n)).filter(F.col("f") >= least)) if n else tables[-1].limit(0))
    return totals, tables


def scored_cuts(phrases: DataFrame, k: int, tables: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, cut): each candidate of `k` words with the cut of the lowest score."""
    parts = F.split("phrase", " ")
    left = lambda c: F.array_join(F.slice(parts, F.lit(1), c), " ")
    right = lambda c: F.array_join(F.slice(parts, c + 1, F.lit(k)), " ")
    every = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cut"))
    every = every.withColumns({"_left": left(F.col("cut")), "_right": right(F.col("cut"))})
    found: DataFrame | None = None
    for cut in range(1, k):
        first, rest = (tables[i - 1].select("lang", F.col("phrase").alias(name), F.col("f").alias(f)) for i, name, f in ((cut, "_left", "l"), (k - cut, "_right", "r")))
        own = every.filter(F.col("cut") == cut).join(first, ["lang", "_left"]).join(rest, ["lang", "_right"])
        found = own if found is None else found.unionByName(own)
    scores = found.join(totals, "lang").withColumn("score", F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    low = F.min_by(F.struct("l", "r", "n", "score", "cut"), F.struct("score", "cut")).alias("_low")
    return scores.groupBy("lang", "phrase", "a").agg(low).select("lang", "phrase", "a", "_low.*")


def held_in_longer(longer: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, most): phrases of `k` words with the frequency of the most frequent phrase of one word more that holds them."""
    parts = F.split("phrase", " ")
    two = F.array(F.array_join(F.slice(parts, 1, k), " "), F.array_join(F.slice(parts, 2, k), " "))
    return longer.select("lang", F.explode(two).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first `top` rows with their rank. While there are many, the first of each of several shares are sought, so that no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = written(rows)
    while (shares := -(-rows.count() // (ROUND * top))) > 1:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        within = Window.partitionBy("lang", "_share").orderBy(*order)
        rows = written(rows.withColumn("_share", share).withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= top).drop("_share", "_rank"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut) of each language's `top` phrases with the highest scores."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    totals, tables = level_tables(texts, least, longest)
    found: DataFrame | None = None
    for k in range(2, longest + 1):
        phrases = tables[k - 1]
        if k < longest:
            kept = F.col("most").isNull() | (100 * F.col("most") < share * F.col("f"))
            phrases = phrases.join(held_in_longer(tables[k], k), ["lang", "phrase"], "left").filter(kept).drop("most")
        own = scored_cuts(phrases, k, tables, totals)
        found = own if found is None else found.unionByName(own)
    return first_of_each(found, top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("cut")


def grams(k: int) -> str:
    return f"SELECT lang, array_to_string(ws[i : i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM p WHERE len(ws) >= {k})"


SQL = {
    "op11_collocations": f"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
    n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
    f AS (SELECT lang, phrase, k, count(*) AS f FROM ({" UNION ALL ".join(map(grams, range(1, LONGEST + 1)))}) GROUP BY ALL HAVING count(*) >= {LEAST}),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.phrase, c.k, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
        FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1 :], ' ') JOIN n ON n.lang = c.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    h AS (SELECT lang, k - 1 AS k, unnest([array_to_string(ws[1 : k - 1], ' '), array_to_string(ws[2 :], ' ')]) AS phrase, a AS most FROM (SELECT DISTINCT lang, k, ws, a FROM c)),
    o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.k = b.k AND h.phrase = b.phrase AND h.most >= b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM o QUALIFY rank <= {TOP}
    """
}
