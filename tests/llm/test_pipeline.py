import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agentlens.llm.common import table, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, DATA, "documents")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], DATA)))
    return found


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    for before, after in zip(steps, steps[1:]):
        assert ids(after) <= ids(before) and after.count() > 0


def test_line_stage_keeps_documents(steps):
    assert ids(steps[2]) == ids(steps[1])


def test_near_duplicates_keep_the_first(spark, steps):
    from test_llm_texts import linked

    texts = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    order = sorted(texts)
    groups = linked([texts[i] for i in order])
    assert ids(steps[3]) == {order[c] for _, c in groups.values()}


def test_leaks_go(spark, steps):
    items = [" ".join(r["text"].lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    left = [" ".join(r["text"].lower().split()) for r in steps[4].collect()]
    assert not any(item in text for item in items for text in left if len(item.split()) > 12)


def test_ids_decode(steps):
    assert steps[5].filter(~F.col("round_trip")).count() == 0 and steps[5].filter("n_tokens <> size(ids)").count() == 0


def test_odd_rows_pass_through(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, more columns with clashing names, and empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "some text of it", "en", "s", 15), (1, "some text of it", "en", "s", 15), (2, None, None, None, None), (None, "no id", "en", None, 5), (None, None, None, None, None), (4, "", "de", "s", 0), (5, "word " * 50_000, "en", "s", 250_000), (-6, "below zero", "en", "s", 10)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for table_rows in (rows, []):
        docs = spark.createDataFrame(table_rows, schema)
        for extra in ("kept", "_gone", "component_id", "_item", "seed"):
            docs = docs.withColumn(extra, F.lit("mine"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, str(tmp_path)))
            assert out.columns == docs.columns, name
            assert out.filter("doc_id IS NULL").count() == docs.filter("doc_id IS NULL").count() and out.filter("kept <> 'mine'").count() == 0, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == len(table_rows) and last.filter("NOT coalesce(round_trip, true)").count() == 0


def test_leaks_without_an_id_go(spark, tmp_path):
    item = " ".join(f"secret{i} question" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"before it {item} and after"), (None, "a clean text without an id"), (None, None), (3, item), (4, "another clean text"), (4, f"{item} again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__", F.lit(1))
    out = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, "a clean text without an id"), (None, None)], key=str)
