"""Rows that repeat or lack an id, very long texts, and the pipeline's stages beside plain versions."""

import collections
import random
import re
import string
import time

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opslens.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
REPEATED = [(1, "same text"), (1, "same text"), (1, "same  text"), (None, "x y"), (None, "x y"), (None, "xy"), (2, "sametext "), (3, None), (None, None), (3, "other")]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _key(row):
    return row[0] is None, row[0] or 0, row[1] or ""


@pytest.mark.parametrize("historical", [None, "false", "doc_id = 1"])
def test_one_row_of_equal_ones_stays(spark, historical):
    found = exact_dedup.exact_dedup(_docs(spark, REPEATED), historical and F.expr(historical)).collect()
    groups = collections.defaultdict(list)
    for row in sorted(REPEATED, key=_key):
        groups[re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")].append(row)
    want = []
    for text, rows in groups.items():
        best = max(range(len(rows)), key=lambda i: (len(rows[i][1] or ""), -i))
        want += [(r[0], rows[best][0], len(rows), i == best, brute.sha(text)) for i, r in enumerate(rows)]
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == collections.Counter(want)
    assert sum(r.kept for r in found) == len(groups)


def test_repeated_rows_elsewhere(spark):
    docs = _docs(spark, REPEATED)
    ids = collections.Counter(d for d, _ in REPEATED)
    for found in (secret_scan.scan_documents(docs, RANKS, PATTERN), token_counts.count_tokens(docs, WORDS, 2048), quality_rules.judge(docs, [])):
        assert collections.Counter(r.doc_id for r in found.collect()) == ids
    tok = Tokenizer.from_file(BYTES)
    lengths = collections.Counter()
    for d, t in REPEATED:
        lengths[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in packing.pack_sequences(docs, BYTES).collect():
        packed[r.doc_id] += r.length
    assert packed == lengths


@pytest.mark.parametrize("unit", ["password=" + "Ab1" * 5 + " ", "".join(random.Random(i).choice(string.ascii_letters + string.digits) for i in range(20)) + "-internationalization-configuration-maintenance-documentation-"])
def test_secrets_of_a_long_text_take_time_in_proportion(unit):
    began = time.time()
    spans = secret_scan.find_spans(unit * (2_000_000 // len(unit)), RANKS, PATTERN)
    assert len(spans) >= 2_000_000 // len(unit) and time.time() - began < 10
    assert len(secret_scan.redact(unit * 50, secret_scan.find_spans(unit * 50, RANKS, PATTERN))) < 50 * len(unit)


def test_a_warm_cache_shuffles_no_text(spark, tmp_path, monkeypatch):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    real = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda texts, path: seen.append(texts._jdf.queryExecution().executedPlan().toString()) or real(texts, path))
    first = token_counts.count_tokens(docs, WORDS, 2048, str(tmp_path / "cache")).collect()
    assert token_counts.count_tokens(docs, WORDS, 2048, str(tmp_path / "cache")).collect() and len(first) == docs.count()
    assert "BroadcastHashJoin" in seen[1]
    monkeypatch.setattr(token_counts, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, token_counts.count_tokens(docs, WORDS, 2048).collect())) == sorted(map(tuple, first))


def test_long_texts(spark):
    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(250_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (3, "a" * 1_500_000), (4, long.replace(" ", "  ", 1)), (5, "short one")]
    docs = _docs(spark, rows)
    tok = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS, 2048).collect()}
    assert counts == {d: len(tok[WORDS].encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_words for r in quality_rules.document_stats(docs).collect()} == {d: len(t.split()) for d, t in rows}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {(1, 4), (2, 2), (3, 3), (4, 4), (5, 5)}
    joined = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect())
    assert joined == sorted(brute.ngram_join(rows))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()) == sorted(brute.substring(rows))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[3] == (1_500_000, 1_500_000, 1) and got[5] == (9, 0, 0) and got[2] == (len(rows[1][1]), len(rows[1][1]), 1)
    packed = collections.Counter()
    for r in packing.pack_sequences(docs, BYTES).collect():
        packed[r.doc_id] += r.length
    assert packed == {d: len(tok[BYTES].encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}


def test_padding_is_little(spark):
    sizes = collections.Counter()
    for r in packing.pack_sequences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BYTES).collect():
        sizes[r.sequence_id] += r.length
    padded = [n if n & (n - 1) == 0 else 1024 for n in sizes.values()]
    assert max(sizes.values()) <= 1024 and sum(padded) <= 1.01 * sum(sizes.values())


def test_base_rule_of_quality(spark):
    for r in quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


@pytest.mark.parametrize("odd", [False, True])
def test_stages_beside_plain_versions(spark, odd):
    """odd: ids repeat or lack, copies among them; each stage judges rows for themselves, in the order of id and text."""
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).collect()]
    rows = sorted((((None if d % 5 == 0 else d // 3) if odd else d, t) for d, t in given + [(1000 + d, t) for d, t in given[:40]]), key=_key)
    extra = [(*r, "x", i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, key string, row int").repartition(4)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=_key)
    texts = {}
    for row in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        if norm not in texts or len(row[1] or "") > len(texts[norm][1] or ""):
            texts[norm] = row
    assert left(corpus_pipeline.exact(spark, docs, SF)) == sorted(texts.values(), key=_key)
    groups = brute.ngram_join([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)
    assert left(corpus_pipeline.near(spark, docs, SF)) == sorted((rows[i] for i, _, c in groups if i == c), key=_key)
    quality = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").collect()
    bad = [r for r in quality if len((r.text or "").split()) < 50]
    assert quality and not bad and {(r.row, r.doc_id, r.text) for r in quality} <= {(i, *r) for i, r in enumerate(rows)}
    clean = {r.row: r.text for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert clean == {i: None if t is None else secret_scan.redact(t, secret_scan.find_spans(t, RANKS, PATTERN)) for i, (_, t) in enumerate(rows)}
