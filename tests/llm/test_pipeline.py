"""The stages of the pipeline beside plain versions."""

import brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns and out.count() <= docs.count()
        if name == "n-gram join":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert {r.doc_id for r in out.select("doc_id").collect()} == {c for _, _, c in brute.ngram_join(rows, 5, 80)}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
