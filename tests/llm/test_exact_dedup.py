"""The buckets of exact deduplication where the history is small or there is one source."""

import pytest
from pyspark.sql import functions as F

from opslens.llm import exact_dedup


@pytest.mark.parametrize("historical", [None, "doc_id < 3", "false", "true"])
@pytest.mark.parametrize("source", ["a"])
def test_buckets_hold_both_sides(spark, monkeypatch, historical, source):
    seen = {}

    def look_up(history, news, buckets, real=exact_dedup.look_up):
        found = real(history, news, buckets)
        bucket = F.pmod(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.lit(buckets))
        seen["largest"] = found.groupBy(bucket).count().agg(F.max("count")).first()[0]
        return found

    monkeypatch.setattr(exact_dedup, "look_up", look_up)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 500).cast("string")).alias("text"), F.lit(source).alias("source"))
    found = exact_dedup.exact_dedup(docs, historical and F.expr(historical), bucket_keys=20).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(i, i % 500, 2 if i % 500 < 100 else 1, i < 500) for i in range(600)}
    assert seen["largest"] <= 60
    if historical is None:
        assert {r.member for r in found} == {True, False}
