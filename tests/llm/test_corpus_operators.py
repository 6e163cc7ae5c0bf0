"""The ten operators beside plain versions, on the test tables and on odd rows."""

import collections
import re
import zlib

import brute
import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opslens.llm import bpe, chat_format, components, exact_dedup, ngram_join, packing, quality_rules, queries, secret_scan, substring_dedup, suffix_dedup, token_counts
from opslens.llm.common import Scratch

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "one two"), (4, "word " * 4000), (5, "word " * 4000), (6, "Ünïcode \x1c ² Σ <|endoftext|> </s>\n" * 30), (7, " \t\n"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 9),
    (9, "A b c d e f g h i j k l m n o p q r s t u v w x y z " * 9), (10, "one two"), (11, "token: abcdefABCDEF123456 AKIA" + "Z" * 20 + " " + "0a" * 20),
]


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def _odd(spark):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in ODD], "doc_id long, text string, key string, h string")


def _inputs(spark):
    for docs in (_documents(spark), _odd(spark), _odd(spark).limit(0)):
        yield docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert not compare.differ(spark, compare.tables(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|end|>\n<|turn|>\\"), (1, 1, "user", "</s>"), (1, 2, "assistant", "\\\\[INST]"), (1, 3, "assistant", None), (2, None, None, ""), (2, None, None, "")]
    found = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = found.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).orderBy("conv_id").collect()
    assert [tuple(t) for t in read[0].t] == [(r or "", x or "") for c, _, r, x in turns if c == 1]
    assert read[0].l == ["\\\\[INST]", ""] and [tuple(t) for t in read[1].t] == [("", ""), ("", "")]


def test_secret_spans(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kinds = [
        ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ]
    for docs, rows in _inputs(spark):
        want = []
        for doc_id, text in rows:
            spans = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= least]
            want.append((doc_id, *(sum(s[1] == i for s in spans) for i in range(3)), brute.sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans)))))
        assert _rows(secret_scan.scan_documents(docs, path, pattern), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert secret_scan.is_random("q9Zx8Lk2Vw7Rt4Yp", path, pattern, 1.9) and not secret_scan.is_random("d41d8cd98f00b204e9800998ecf8427e", path, pattern, 1.9)


def test_token_counts_and_bpe(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for i, (docs, rows) in enumerate(_inputs(spark)):
        ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in rows}
        counts = sorted((d, len((t or "").encode()), len(ids[d]), len(ids[d]) > 2048) for d, t in rows)
        for _ in range(2):  # the second time from the cache
            assert _rows(token_counts.count_tokens(docs, path, 2048, str(tmp_path / f"cache{i}")), "doc_id", "n_bytes", "n_tokens", "over_limit") == counts
        want = sorted((d, len(x), brute.sha(" ".join(map(str, x))), brute.sha(tok.decode(x, skip_special_tokens=False))) for d, x in ids.items())
        assert _rows(bpe.encode_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_quality_statistics(spark):
    for docs, rows in _inputs(spark):
        want = []
        for doc_id, text in rows:
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            seen = collections.Counter(zip(words, words[1:], words[2:]))
            hit = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(i, i + 3)}
            want.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)))
        assert _rows(quality_rules.document_stats(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want)


def test_decision_list_learns_a_threshold():
    rng = np.random.default_rng(3)
    x = {"a": rng.uniform(size=600), "b": rng.uniform(size=600)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality_rules.learn_list(x, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= quality_rules.covered(rule, x, 600)
    assert rules and (hit == bad).mean() > 0.97


def test_learned_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels.filter("doc_id % 3 <> 0"))
    kept = quality_rules.judge(docs, rules).join(labels.filter("doc_id % 3 = 0 and quality = 1"), "doc_id").filter("not base_failed")
    assert kept.filter("kept").count() >= 0.95 * kept.count()


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, words, percent):
    for docs, rows in _inputs(spark):
        assert _rows(ngram_join.jaccard_groups(docs, words, percent), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_join(rows, words, percent))


def test_ngram_join_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(400):  # copies with edits, so that only some of the pairs link
        words = list(base)
        for i in rng.integers(0, 150, int(rng.integers(0, 9))):
            words[i] = f"x{rng.integers(1000)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(ngram_join.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_join(rows))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert _rows(components.components(links, Scratch(spark, "test"), "chain"), "node", "root") == sorted([(i, 0) for i in range(41)] + [(100, 100), (101, 100)])


def test_substring_and_suffix_dedup(spark):
    for docs, rows in _inputs(spark):
        assert _rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(rows))
        assert _rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(rows))


def test_hot_least_grams_are_exact(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", 2)
    docs = _documents(spark)
    assert _rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("most", [1, 5])
def test_a_passage_in_many_surroundings_is_split_until_groups_are_small(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", most)
    random = np.random.default_rng(3)
    text = lambda n: "".join(random.choice(list("abcd"), n))
    passage, befores, afters = text(150), [text(70) for _ in range(6)], [text(70) for _ in range(6)]
    rows = [(i, text(int(random.integers(40))) + befores[i % 6] + passage + afters[i // 7 % 6] + text(int(random.integers(40)))) for i in range(48)]
    rows += [(100, "x" + passage + "y"), (101, "ab" * 300), (102, "ab" * 150 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(rows))


def test_prefix_bounds():
    text = b"abracadabra abracad"
    symbols = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64) + 1, [0]])
    symbols = np.unique(symbols, return_inverse=True)[1]
    order = suffix_dedup.sort_suffixes(symbols, 6)
    found = suffix_dedup.prefix_bounds(symbols[order - 1], 6)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] :], text[order[i] :]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (found[i] if found[i] >= 0 else 6) == min(same, 6)


def test_exact_dedup(spark):
    for docs, rows in _inputs(spark):
        groups = collections.defaultdict(list)
        for doc_id, text in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
        want = [(d, min(g)[1], len(g), d == min(g)[1], brute.sha(t)) for t, g in groups.items() for _, d in g]
        for historical in (None, F.col("doc_id") % 3 == 0, F.lit(False)):
            assert _rows(exact_dedup.exact_dedup(docs, historical), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want)


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for docs, rows in _inputs(spark):
        ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
        found = packing.pack_sequences(docs, path).collect()
        at = collections.defaultdict(int)
        for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at[r.doc_id], zlib.crc32(part.tobytes()), len(ids[r.doc_id]))
            at[r.doc_id] += r.length
        assert at == {d: len(x) for d, x in ids.items()}
        ends = collections.defaultdict(int)
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends[r.sequence_id]
            ends[r.sequence_id] += r.length
        assert all(n <= 1024 for n in ends.values())


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20), (1, "a b c " * 20), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 4
    assert suffix_dedup.remove_repeats(docs).count() == 4
    found = ngram_join.jaccard_groups(docs).collect()
    assert len(found) == 4 and [r.component_id for r in found if r.doc_id == 1] == [1, 1]
    assert exact_dedup.exact_dedup(docs).count() == 4
