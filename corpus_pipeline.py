"""A training corpus from documents: quality rules, exact copies, near copies, secrets, packing.

STAGES holds the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents. run() applies them to the documents of sf_dir and writes each result before the next stage reads it.

Each stage numbers its rows where ids are null or repeat, and its operator's decisions go back to rows by that number.

Defined results: null text counts as empty and fails the quality rules; rows that have no doc_id or repeat one are judged
each for itself, like all others, in the order of doc_id (null ids last) and text where the least id decides; extra columns
pass through all stages but the last; an empty table gives an empty result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan
from opslens.llm.common import Scratch, table


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a column that tells rows apart, and its name: the doc_id, or numbers in the order of doc_id and text."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count():
        return docs.withColumn(row, F.col("doc_id")), row
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    return Scratch(docs.sparkSession, "pipeline-rows").save(numbered, name), row


def _kept(docs: DataFrame, name: str, choose) -> DataFrame:
    """The documents whose number (as doc_id) `choose` gives of the documents numbered so."""
    numbered, row = _numbered(docs, name)
    chosen = choose(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row))
    return numbered.join(chosen, row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, "quality", lambda rows: quality_rules.judge(rows, rules).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one that stays."""
    return _kept(docs, "exact", lambda rows: exact_dedup.exact_dedup(rows).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the least id."""
    return _kept(docs, "near", lambda rows: ngram_join.jaccard_groups(rows, words=5, percent=80).filter("component_id = doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark, and n_chars of what is left."""
    clean = secret_scan.redact_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram join", near), ("secret scan", secrets), ("packing", packed)]
#: SQL cannot express tokenizers and a learned list; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
