"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, n_tokens). Contents are normalised in a way that no count
depends on (runs of white space become one space for tokenizers that drop it), digested, and joined to the cache. Digests
alone meet the cache; of those that it lacks, one text each is encoded, and the new counts are appended as files of their
own, so that a lost executor or a repeated task leaves no half-written entry. Equal contents are thus encoded once, ever.
Few misses (MOST_BROADCAST digests) are broadcast to the texts, so that a warm cache shuffles none; of more, a text for each
digest and task is shuffled. Of the cache only what the batch's digests name is grouped.

Defined results: null text counts as empty and has 0 tokens; repeated rows and rows without a doc_id count once each; extra
columns are ignored; an empty table gives an empty result and leaves the cache as it is."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import Scratch, clean, strings

#: Misses that are broadcast, of 32 bytes each.
MOST_BROADCAST = 500_000
CACHE = "content_sha256 binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text, drops_white: bool):
    """The digest of a text's normalised content."""
    content = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ") if drops_white else text
    return F.unhex(F.sha2(content.cast("binary"), 256))


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """content_sha256, n_tokens of each row of (content_sha256, text)."""

    def run(batches):
        split, tok, memo = vocab.word_split(tokenizer_path), vocab.tokenizer(tokenizer_path), _memo(tokenizer_path)
        for batch in batches:
            counts = [
                sum(map(memo.__getitem__, split(text))) if vocab.is_plain(text) else len(tok.encode(text, add_special_tokens=False).ids)
                for text in strings(batch)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("content_sha256"), pa.array(counts, pa.int64())], names=["content_sha256", "n_tokens"])

    return texts.mapInArrow(run, "content_sha256 binary, n_tokens long")


def _memo(path: str) -> vocab.Memo:
    def make():
        ids = vocab.word_ids(path)
        return vocab.Memo(lambda word: len(ids(word)))

    return vocab.held(("token counts", path), make)


def read_cache(spark, path: str) -> DataFrame:
    """The cache, empty where nothing has been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, cache_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, content_sha256. Without a cache_path the cache is a new one."""
    spark = docs.sparkSession
    store = Scratch(spark, "token-counts")
    path = cache_path or store.path("cache")
    version = tokenizer_digest(tokenizer_path)
    drops_white = bool(vocab.tokenizer(tokenizer_path).model.end_of_word_suffix)
    text = clean()
    texts = docs.select(content_digest(text, drops_white).alias("content_sha256"), text.alias("text"))
    # Tables are written, as Spark splits a frequent digest's rows only where both sides of a join come from a shuffle of their own.
    rows = store.save(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text, drops_white).alias("content_sha256")), "rows")
    wanted = store.save(rows.select("content_sha256").distinct(), "wanted")
    cached = read_cache(spark, path).filter(F.col("tokenizer") == version).join(wanted, "content_sha256", "left_semi")
    # Writers that ran at once may both have appended a digest; its counts are equal.
    known = store.save(cached.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens")), "known")
    missing = store.save(wanted.join(known, "content_sha256", "left_anti"), "missing")
    few = missing.count() <= MOST_BROADCAST
    texts = texts.join(F.broadcast(missing), "content_sha256", "left_semi") if few else texts
    # One text of each digest: combined within tasks first, so that copies shuffle as one row per task.
    misses = texts.groupBy("content_sha256").agg(F.first("text").alias("text"))
    misses = misses if few else misses.join(missing, "content_sha256", "left_semi")
    new = store.save(encode_counts(misses, tokenizer_path), "new")
    new.select("content_sha256", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(path)
    store.drop("wanted", "missing")
    return rows.join(store.save(known.unionByName(new), "counts"), "content_sha256").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("content_sha256")).alias("content_sha256")
    )
