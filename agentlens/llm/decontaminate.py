"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask such as `11110111` reads some of the token positions under it and
ignores the others. Every place of every document and of every benchmark item
is hashed under each mask; equal hashes are hits. A hit fixes how the item lies
on the document, and around it the two are compared token by token: the item
leaks if some window of `WINDOW` tokens (the whole item, if it is shorter)
agrees in `AGREE_PERCENT` of them or more, so replaced words do not hide it.

No such window is missed: wherever the replaced words stand in it, at least one
place of one mask sees none of them (a test tries all patterns). Shorter items
have shorter masks, and items of up to four tokens, of which all must agree, are
one mask as a whole. Documents are hashed under the masks of the lengths that the
benchmark has.

Tokens are runs of letters and digits in lower case. Defined cases: a null or
empty text has no tokens; an item without tokens leaks nowhere; repeated items
and repeated documents are one row for each pair of ids, also if their texts
differ or an id is null; of several places of an item in a document the best
agreeing one is reported (then the first); a text of any length is compared as a
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text, written

WINDOW, AGREE_PERCENT = 13, 80
#: By the least number of tokens of an item that they are for; lossless for windows of that many tokens and more.
MASKS = {
    13: ("11110111", "11111101", "11001001111"),
    10: ("1110111", "1011111", "11111001", "111001011", "1100101011"),
    5: ("1111", "11011", "10111", "11101"),
    **{n: ("1" * n,) for n in (4, 3, 2, 1)},
}
#: Seed rows (24 bytes each) up to this number are broadcast; a larger benchmark joins by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Hits of documents up to this number (under 50 bytes each) are broadcast; more join by shuffle.
BROADCAST_HITS = 1_000_000
BLOCK = 64  # places hashed together


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.lower(whole_text(text)), r"[^\p{L}\p{N}]+"), "")


def once(c: Column) -> Column:
    """Evaluated in a step of its own, where several later expressions would each do so again."""
    return F.explode(F.array(c))


def masked_hash(mask: str) -> Column:
    """The hash of what the mask reads from `_in` on; null if it doesn't fit there."""
    read = [F.get("_part", F.col("_in") + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(F.col("_in") + len(mask) <= F.size("_part"), F.xxhash64(F.lit(mask), *read))


def seeds(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep, _at, seed) for each place of `_words` and each mask; narrow, in steps of `BLOCK` places, so that rows stay small in a text of any length."""
    hashed = rows.select(*keep, once(F.transform("_words", lambda w: F.xxhash64(w))).alias("_hashes"))
    last = F.floor((F.size("_hashes") - 1) / BLOCK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("_hashes", b * BLOCK + 1, F.lit(BLOCK + max(map(len, masks)) - 1)))
    placed = hashed.select(*keep, F.posexplode(parts).alias("_block", "_part")).select(*keep, "_block", "_part", F.explode(F.sequence(F.lit(0), F.least(F.size("_part"), F.lit(BLOCK)) - 1)).alias("_in"))
    return placed.select(*keep, (F.col("_block") * BLOCK + F.col("_in")).alias("_at"), F.explode(F.array(*map(masked_hash, masks))).alias("seed")).filter(F.col("seed").isNotNull())


def item_seeds(items: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """(seed, _item, _item_at, _item_n) of items (_item, _words), each under the masks for its length; and all masks used."""
    bounds = sorted(MASKS, reverse=True)
    family = F.coalesce(*[F.when(F.size("_words") >= n, F.lit(n)) for n in bounds])
    rows = items.withColumn("_family", family).withColumn("_item_n", F.size("_words"))
    used = sorted((r["_family"] for r in rows.select("_family").distinct().collect() if r["_family"]), reverse=True) or bounds[:1]  # one of seven
    each = [seeds(rows.filter(F.col("_family") == n), MASKS[n], "_item", "_item_n") for n in used]
    every = reduce(DataFrame.unionByName, each).select("seed", "_item", F.col("_at").alias("_item_at"), "_item_n").distinct()
    return every, tuple(m for n in used for m in MASKS[n])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(key, item_key, start, n_compared, n_equal, best_window): a row for each document and item that leaks into it."""
    item_words = written(items.select(F.col(item_key).alias("_item"), tokens(item_text).alias("_words")).filter(F.size("_words") > 0).distinct())
    found, masks = item_seeds(item_words)
    own = written(found)
    small = own.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    texts_of = docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_name"), F.col(text).alias("_text"))
    rows = texts_of.select("_doc", "_name", once(tokens("_text")).alias("_words")).filter(F.size("_words") > 0)
    shift = (F.col("_at") - F.col("_item_at")).alias("_shift")
    hits = seeds(rows, masks, "_doc", "_name").join(F.broadcast(own) if small else own, "seed").select("_doc", "_name", "_item", shift, "_item_n").distinct()
    # the texts that were hit come to their hits, once each; others are not read again beyond their name
    of_text = written(hits.groupBy(F.col("_doc").alias("_hit"), F.col("_name").alias("_hit_name")).agg(F.collect_list(F.struct("_item", "_shift", "_item_n")).alias("_hits")))
    few = of_text.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS and of_text.agg(F.coalesce(F.sum(F.size("_hits")), F.lit(0))).first()[0] <= BROADCAST_HITS
    met = texts_of.join(F.broadcast(of_text) if few else of_text, F.col("_doc").eqNullSafe(F.col("_hit")) & (F.col("_name") == F.col("_hit_name")))
    part = lambda h: F.array_join(F.slice("_words", F.greatest(h["_shift"], F.lit(0)) + 1, h["_item_n"] + F.least(h["_shift"], F.lit(0))), " ")
    parts = F.transform("_hits", lambda h: F.struct(h["_item"].alias("_item"), h["_shift"].alias("_shift"), part(h).alias("_part")))
    # a part is as long as an item, so what meets in a group is small; copies of a place fall together before the shuffle
    placed = met.select("_doc", "_hits", once(tokens("_text")).alias("_words")).select("_doc", F.inline(parts)).distinct()
    texts = item_words.select(F.col("_item").alias("_of"), F.col("_words").alias("_item_words"))
    pairs = placed.join(F.broadcast(texts) if small else texts, F.col("_item").eqNullSafe(F.col("_of")))
    equal = F.zip_with(
        F.split("_part", " "),
        F.slice("_item_words", F.greatest(-F.col("_shift"), F.lit(0)) + 1, F.size("_item_words")),
        lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int")),
    )
    compared = pairs.withColumn("_equal", F.filter(equal, lambda x: x.isNotNull())).withColumn("n_compared", F.size("_equal")).withColumn("_width", F.least(F.lit(WINDOW), F.size("_item_words")))
    whole = compared.filter(F.col("n_compared") >= F.col("_width"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(1), F.col("n_compared") - F.col("_width") + 1), lambda i: total(F.slice("_equal", i, F.col("_width"))))
    scored = whole.withColumn("best_window", F.array_max(windows)).withColumn("n_equal", total(F.col("_equal"))).filter(100 * F.col("best_window") >= AGREE_PERCENT * F.col("_width"))
    best = F.max(F.struct("best_window", "n_equal", (-F.greatest("_shift", F.lit(0))).alias("_start"), "n_compared")).alias("_best")
    return (
        scored.groupBy("_doc", "_item")
        .agg(best)
        .select(F.col("_doc").alias(key), F.col("_item").alias(item_key), (-F.col("_best._start")).cast("bigint").alias("start"), F.col("_best.n_compared").cast("bigint").alias("n_compared"), F.col("_best.n_equal").cast("bigint").alias("n_equal"), F.col("_best.best_window").cast("bigint").alias("best_window"))
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
