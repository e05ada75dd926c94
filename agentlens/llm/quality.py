"""Quality selection by importance resampling.

Two generative models over hashed n-grams are fitted: the target model on
labelled rows that are good, the raw model on all documents. The n-grams are
single tokens and the first 4 to 7 characters of longer ones (word stems), so the
models know nothing of the order of words; they fall into `BUCKETS` buckets. A bucket's weight is the log ratio of the number of times
the target model has it to the number that the raw model leads one to expect,
both with `SMOOTHING` added, so that rare buckets weigh little. A document's log
weight is the sum over its n-grams, over `n ** LENGTH_POWER`. One line is fitted
on other labelled rows than the target model's (so that these stand for unlabelled
documents) to turn weights into log odds of being target, the number to
keep is the expected number of target documents, and the sample is the Gumbel
top-k of the log odds times `SHARPNESS`: k documents without replacement, by
noise that a hash of the id fixes. The sharpness keeps clear cases out of chance's
reach: only documents near even odds are drawn for.

Every document is counted and scored, whole. Labelled rows used for fitting are
bounded by `FIT_ROWS` (those with the smallest hashes of their ids); tables of
bucket weights and of score bins have fixed sizes and are the only things that
reach the driver.

Defined cases: a null or empty text has no n-grams and the weight 0, which the
fitted line maps like any other; ties in the sample go to the smaller id;
without labels of both kinds every document is kept; repeated rows of one id
are one document, kept or left together, and so are the rows without an id; labels
without an id or a quality are ignored; other columns, whatever their names, are
ignored by `selected`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text, written

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
STEMS = (4, 5, 6, 7)
BUCKETS = 1 << 20
FOLDS = 4  # of labelled rows: one for the line, the others for the target model
SMOOTHING = 1.0
LENGTH_POWER = 0.5
SHARPNESS = 4.0
FIT_ROWS = 200_000
SEED = 5
BINS = 4096
LAST_ROWS = 20_000


def grams(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, *keep, bucket) for each n-gram of each document; one narrow stage."""
    words = docs.select(key, *keep, F.explode(F.regexp_extract_all(whole_text(text), F.lit(TOKEN), F.lit(0))).alias("_word"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    stem = lambda n: F.when(F.char_length("_word") > n, bucket(F.lit(n), F.substring("_lower", 1, n)))
    each = F.array(bucket("_word"), *map(stem, STEMS))
    return words.withColumn("_lower", F.lower("_word")).select(key, *keep, F.explode(each).alias("bucket")).filter(F.col("bucket").isNotNull())


def labelled(labels: DataFrame, key: str) -> DataFrame:
    """(key, target, for_line): bounded by `FIT_ROWS`; a row is target if its quality is 1 and it isn't toxic."""
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
    one = known.groupBy(key).agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("target"))
    some = one.orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(FIT_ROWS)
    return some.withColumn("for_line", F.pmod(F.xxhash64(key, F.lit(SEED + 1)), F.lit(FOLDS)) == 0)


def bucket_weights(docs: DataFrame, fit: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, weight) for every bucket that occurs; both models are counted in one scan."""
    model = fit.filter(~F.col("for_line")).select(key, "target")
    marked = docs.select(key, text).join(F.broadcast(model), key, "left")  # at most FIT_ROWS ids
    counts = written(grams(marked, key, text, "target").groupBy("bucket").agg(F.count("*").alias("n_raw"), F.sum(F.coalesce("target", F.lit(0))).alias("n_target")))
    sums = counts.agg(F.sum("n_raw").alias("raw"), F.sum("n_target").alias("target")).first()
    expected = F.col("n_raw") * F.lit((sums["target"] or 0) / (sums["raw"] or 1))
    return counts.select("bucket", F.log((F.col("n_target") + SMOOTHING) / (expected + SMOOTHING)).alias("weight"))


def log_weights(docs: DataFrame, weights: DataFrame, key: str, text: str) -> DataFrame:
    """(key, log_weight, n_grams); the sum is of whole millionths, so it doesn't depend on the order."""
    scored = grams(docs, key, text).join(F.broadcast(weights), "bucket")  # at most BUCKETS rows
    sums = scored.groupBy(key).agg(F.sum(F.round(F.col("weight") * 1e6).cast("bigint")).alias("_sum"), F.count("*").alias("n_grams"))
    return sums.select(key, (F.col("_sum") / 1e6 / F.pow("n_grams", F.lit(LENGTH_POWER))).alias("log_weight"), "n_grams")


def fitted_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds of y at x, by Newton's steps with a small ridge."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1])


def gumbel(key: str) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_k(scored: DataFrame, k: int, key: str, score: str) -> DataFrame:
    """The k rows with the largest scores, ties to smaller keys: bins are counted and the bin of the k-th row is cut again, until few rows are left to sort."""
    kept = scored.filter(F.lit(False))
    rest = scored
    while True:
        s = rest.agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).first()
        if k >= s["n"]:
            return kept.unionByName(rest)
        if k <= 0:
            return kept
        if s["n"] <= LAST_ROWS or s["low"] == s["high"]:
            last = rest.orderBy(F.desc(score), key).limit(k)
            return kept.unionByName(last)
        step = (s["high"] - s["low"]) / BINS
        bin_of = F.least(F.floor((F.col(score) - F.lit(s["low"])) / F.lit(step)), F.lit(BINS - 1))
        above = 0
        for b, n in sorted(((r[0], r[1]) for r in rest.groupBy(bin_of.alias("b")).count().collect()), reverse=True):
            if above + n > k:
                break
            above += n
        kept = kept.unionByName(rest.filter(bin_of > b))
        rest, k = rest.filter(bin_of == b), k - above


def selected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, log_weight, n_grams, log_odds, sample_score, kept): a row for each distinct id."""
    docs = docs.select(key, text)
    fit = written(labelled(labels, key))
    ids = docs.select(key).distinct()
    weights = bucket_weights(docs, fit, key, text)
    found = log_weights(docs, weights, key, text).withColumnRenamed(key, "_of")
    scores = written(ids.join(found, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of").fillna(0, ["log_weight", "n_grams"]))
    known = scores.join(F.broadcast(fit.filter("for_line")), key).select("log_weight", "target").toPandas()  # at most FIT_ROWS rows
    if known["target"].nunique() < 2:
        return scores.withColumns({"log_odds": F.lit(0.0), "sample_score": F.lit(0.0), "kept": F.lit(True)})
    slope, offset = fitted_line(known["log_weight"].to_numpy(float), known["target"].to_numpy(float))
    odds = F.col("log_weight") * slope + offset
    sampled = scores.withColumn("log_odds", odds).withColumn("sample_score", F.col("log_odds") * SHARPNESS + gumbel(key))
    expected = sampled.agg(F.sum(F.round(1e6 / (1 + F.exp(-F.col("log_odds")))).cast("bigint"))).first()[0] or 0
    kept = top_k(sampled.select(key, "sample_score"), int(math.ceil(expected / 1e6)), key, "sample_score").select(F.col(key).alias("_of"), F.lit(True).alias("kept"))
    return sampled.join(kept, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of").fillna(False, ["kept"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("log_weight", 6).alias("log_weight"), "n_grams", F.round("log_odds", 6).alias("log_odds"), "kept")
