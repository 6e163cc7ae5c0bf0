"""Long conversations and words, planted secrets, the lasting cache, and the learned list on bad rows."""

import random
import re
import string
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opslens.llm import bpe, chat_format, quality_rules, secret_scan, token_counts, vocab

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("roles", [("user", "assistant"), ("assistant",)])
def test_a_conversation_of_many_turns(spark, roles):
    turns = spark.range(16_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % len(roles) + 1).cast("int")).alias("role"), F.concat(F.lit("</s>text "), F.col("id")).alias("text")
    )
    began = time.time()
    found = chat_format.chat_digests(chat_format.format_chats(turns)).collect()[0]
    assert time.time() - began < 60
    loss = "".join(f"</s>text {i}" for i in range(16_000) if roles[i % len(roles)] == "assistant")
    assert (found.n_turns, found.loss_chars) == (16_000, len(loss))


def test_conversations_without_id_and_with_more_columns(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", None, 2), (5, 0, None, "x", 3), (5, 0, "assistant", "y", 4)]
    found = chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks long"))).collect()
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in found} == {(None, 2, 0), (5, 2, 1)}
    assert chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("word", ["".join(random.Random(3).choice(string.ascii_lowercase) for _ in range(1_000_000)), "ab" * 300_000, "a" * 500_000])
def test_a_very_long_word(word):
    began = time.time()
    assert bpe.Bpe(WORDS).encode_words([word])[0] == vocab.tokenizer(WORDS).encode(word, add_special_tokens=False).ids
    assert time.time() - began < 60


def _found(text):
    return [(start, end) for start, kind, end in secret_scan.find_spans(text, RANKS, public_tokenizers.PATTERN) if kind == 3]


@pytest.mark.parametrize(
    "alphabet,least", [(string.ascii_letters + string.digits, 0.98), (string.ascii_letters, 0.98), (string.ascii_lowercase + string.digits, 0.95), ("0123456789abcdef", 0.85), (string.ascii_letters + string.digits + "+/", 0.98)]
)
def test_planted_random_strings(alphabet, least):
    rnd = random.Random(7)
    for n in (16, 20, 24):
        planted = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(400)]
        for before in ("the ", "authorization=", 'AccountKey = "'):
            assert sum(bool(_found(before + p + " end")) for p in planted) >= least * 400


def test_digests_count_only_where_assigned():
    sha1 = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    assert not _found(f"commit {sha1} of the day") and _found(f'token = "{sha1}" of the day')


def test_no_random_span_in_clean_prose(spark):
    """Runs without digits, capitals inside words and signs are prose; none of the given documents has a span in one."""
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert not [text[a:b] for a, b in _found(text or "") if re.fullmatch("[A-Z]?[a-z]+", text[a:b])]


def test_spans_column(spark):
    """Of all runs of key characters, exactly those that are neither known nor within the threshold, by a plain rule."""
    enc = secret_scan.ranks_encoding(RANKS, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["x QxZvKpWmRtYuLkJhGfDs y", "Zm9vYmFyMTIzNDU2Nzg5 0"]
    seen = 0
    for text in texts:
        want = set()
        assigned = [m.span() for m in secret_scan.PATTERNS[0][1].finditer(text) if len(m[2]) >= 12]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text):  # no run of these texts holds an equals sign
            run, inside = m[0], any(a < m.end() and m.start() < b for a, b in assigned)
            joined = re.fullmatch(r"([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([-_/+]([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*", run)
            digest = re.fullmatch("[0-9a-f]+", run) and len(run) in (32, 40, 48, 56, 64, 96, 128)
            if not re.search("[-/_+]", run) and re.search("[A-Za-z]", run) and not joined and (inside or not digest) and len(run) < 1.9 * len(enc.encode_ordinary(run)):
                want.add(m.span())
        got = {s for s in _found(text) if not re.search("[-/_+=]", text[slice(*s)])}
        assert want <= got and all(re.search("[-/_+=]", text[max(0, a - 1)] + text[b : b + 1]) for a, b in got - want)
        seen += len(want)
    assert seen >= 10


def test_the_cache_lasts(spark, tmp_path, monkeypatch):
    encoded = []
    real = token_counts.encode_counts

    def counted(texts, path):
        encoded.append(texts.count())
        return real(texts, path)

    monkeypatch.setattr(token_counts, "encode_counts", counted)
    rows = [(1, "one two"), (2, "one  two"), (None, "three"), (2, None), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(9, "four"), (9, "three")], "doc_id long, text string"))
    first = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs, WORDS, 2048, str(tmp_path / "cache")).collect())
    second = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(more, WORDS, 2048, str(tmp_path / "cache")).collect())
    assert encoded == [3, 1] and len(first) == 5 and len(second) == 7 and set(first) < set(second)
    assert token_counts.count_tokens(docs.limit(0), WORDS, 2048, str(tmp_path / "cache")).count() == 0


def test_learned_rules_reject_bad_rows_that_were_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality_rules.fit(docs, labels.filter("doc_id % 3 <> 0"))
    judged = quality_rules.judge(docs, rules).join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert rules and n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, False), 0) + n.get((1, True), 0))
    # The verdict is the first rule that holds, told without Spark.
    import numpy as np

    rows = judged.select("kept", "rule", *(F.expr(f).alias(x) for x, f in quality_rules.FEATURES.items())).toPandas()
    x = {f: rows[f].to_numpy() for f in quality_rules.FEATURES}
    hit = np.zeros(len(rows), bool)
    for rule in rules:
        hit |= np.logical_and.reduce([x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold for c in rule])
    assert (rows["kept"].to_numpy() == ~hit).all()


def test_labels_and_documents_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(i % 40, "good words " * 40 if i % 2 else "bad") for i in range(200)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels, max_labels=30) == quality_rules.fit(docs.repartition(5), labels.repartition(3), max_labels=30)
    assert quality_rules.judge(docs, []).count() == 201
