"""Packing under a limit of loss-bearing tokens that binds; how words are split and held."""

import collections
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

from opslens.llm import packing, vocab


def test_loss_masks(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = []
    for d in range(40):
        text = "question and answer " * (5 + 37 * d % 400)
        n = len(tok.encode(text, add_special_tokens=False).ids)
        rows.append((d, text, None if d == 7 else [i >= n * (d % 5) // 5 for i in range(n)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer array<boolean>").coalesce(1)
    found = packing.pack_sequences(docs, path, max_loss=300, loss="answer").collect()
    masks = {d: [*(m or [True] * len(tok.encode(t, add_special_tokens=False).ids)), False] for d, t, m in rows}
    at, tokens, loss = (collections.Counter() for _ in range(3))
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.loss_tokens == sum(masks[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] += r.length
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
    assert at == {d: len(m) for d, m in masks.items()}
    assert max(tokens.values()) <= 1024 and 290 <= max(loss.values()) <= 300 and max(tokens.values()) > 301


def test_memo_holds_a_long_tail_of_words(monkeypatch):
    encoded = []
    monkeypatch.setattr(vocab, "word_ids", lambda path: lambda word: encoded.append(word) or [len(word)])
    monkeypatch.setattr(vocab, "_HELD", {})
    memo = packing._memo("any")
    for _ in range(2):
        for i in range(500_000):
            memo[f" word{i}"]
    assert len(encoded) == 500_000


def test_byte_words():
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab'stmdrvel  \n\t_09ÄéßñЖ中́.,!-² ªⅣ😀İ") for _ in range(rng.randint(0, 14)))
        assert vocab.byte_words(text) == plain.findall(text)
