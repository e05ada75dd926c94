"""A training corpus from `documents`: five stages, each written as Parquet and reread as the next one's documents.

All stages but the last return the columns of documents, more columns included, and
treat odd rows alike: a null text is empty and stays null; rows that repeat an id are
one document in decisions (they stay or go together); rows without an id can't be
named by a decision and stay, but for decontamination, which names them by their text;
equal texts are treated equally; a text of any length
is worked on as a whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm import decontaminate, ngram_join, quality, sentence_pieces, templates
from agentlens.llm.common import table, without_ids, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    judged = quality.selected(docs, table(spark, sf_dir, "labels"))
    return without_ids(docs, judged.filter(~F.col("kept") & F.col("doc_id").isNotNull()))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines of recurring templates."""
    kept = templates.without_templates(docs)
    length = F.when(F.col("n_lines_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    groups = ngram_join.near_duplicates(docs)
    return without_ids(docs, groups.filter(F.col("component_id") != F.col("doc_id")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents into which a benchmark item leaks; rows without an id go by their text."""
    items = table(spark, sf_dir, "benchmark")
    kept = without_ids(docs, decontaminate.leaks(docs, items))
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return kept
    name = "_" * (1 + max(map(len, docs.columns)))
    told = lambda df: df.withColumn(name, F.when(F.col("doc_id").isNull(), F.sha2("text", 256)))
    gone = decontaminate.leaks(told(nameless).filter(F.col(name).isNotNull()).select(name, "text").distinct(), items, key=name)
    return without_ids(told(kept), gone, name).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    coded = sentence_pieces.encoded(docs, sentence_pieces.model_path())
    same = F.col("decoded") == F.col("text")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_template_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: Hash-based sampling, set similarity and segmentation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
