"""Line dedup, conversation repair and importance resampling: beside SQL, beside plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute_repair
import compare
import pytest
from pyspark.sql import functions as F

from opslens.llm import importance, line_dedup, queries, turn_repair

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_turn_repair", "op13_importance"])
def test_beside_sql(spark, name):
    assert not compare.differ(spark, compare.tables(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def _lines(rows):
    """(doc_id, n_lines, n_dropped, kept_sha256) of rows in their order."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    holder, out = {}, []
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holder.setdefault(key(line), i)
    for i, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if holder.get(key(x), i) == i]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("share,least", [(1024, 1000), (4, 2)])
def test_lines_of_odd_documents(spark, monkeypatch, share, least):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(line_dedup, "HOT_LINES", least)
    rnd, pool = random.Random(1), ["a common line of text", " A Common LINE of text\r", "short", "", "\t", "élan vital über", "ÉLAN vital über", "ten chars.", "x" * 50_000]
    texts = ["\n".join(rnd.choice([*pool, f"own line {i} {rnd.random()}"]) for _ in range(rnd.randint(1, 12))) for i in range(80)]
    texts += [None, "", "\n", "\n\n", "a common line of text", "a common line of text"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, key string, h1 int, place int").repartition(5)
    assert Counter(map(tuple, line_dedup.dedup_lines(docs).drop("dropped").collect())) == _lines(rows)
    # Ids that repeat or lack: rows stand in the order of id, null last, and text.
    odd = sorted(((i // 3 if i % 7 else None, t) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, line_dedup.dedup_lines(docs).drop("dropped").collect())) == _lines(odd)


def test_lines_of_long_documents_and_none(spark):
    long = "\n".join(f"line number {i % 50_000}" for i in range(200_000))
    rows = [(1, "line number 7\nother words here"), (2, long), (3, long)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == _lines(rows)
    assert {r.doc_id: r.kept_text for r in found}[3] == ""
    assert {r.doc_id: [tuple(x) for x in r.dropped] for r in found} == {1: [], 2: [(7 + 50_000 * i, 1) for i in range(4)], 3: [(0, 200_000)]}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_occurrences_stream_after_one_exchange_by_ranges(spark):
    lines = spark.range(10).selectExpr("id as h1", "id as h2", "id as key", "0 as place")
    plan = line_dedup.later_lines(lines, spark.createDataFrame([], "h1 long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    window = plan[plan.index("Window") : plan.index("rangepartitioning")]
    assert "hashpartitioning" not in window


def _beside_plain(spark, turns, broken=True):
    groups = {}
    for r in turns.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r.conv_id, []).append(tuple(r))
    want = {c: brute_repair.repaired(brute_repair.damaged(g)) for c, g in groups.items()}
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_digests(turn_repair.damage(turns)).collect()} == want


@pytest.mark.parametrize("bits", [12, 1])
def test_repair_of_odd_turns(spark, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", bits)
    rnd = random.Random(bits)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "up"], ["a.", "b", "  ", None, "c?\n", "héé.", ""]
    rows = [(None if c == 3 else c, rnd.choice([None, *range(6)]), rnd.choice(roles), rnd.choice(texts), c, "k") for c in range(60) for _ in range(rnd.randint(1, 9))]
    _beside_plain(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int, conv string").repartition(4))


def test_repair_of_a_long_conversation_by_segments(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", 6)
    rnd = random.Random(2)
    rows = [(9, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", f"b {i}", " ", f"c{i}?", f"d{i}."])) for i in range(1500)]
    _beside_plain(spark, spark.createDataFrame([*rows, (1, 0, "user", "hi.")], "conv_id long, turn long, role string, text string").repartition(7))


def test_repair_without_damage_and_of_nothing(spark):
    rows = [(1, 0, "user", "q?"), (1, 1, "user", "q?"), (1, 2, "assistant", "a."), (2, 0, "assistant", "only.")]
    found = turn_repair.repair_digests(turn_repair.whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {(r.conv_id, r.cost, r.audit) for r in found} == {(1, 2, "KDK"), (2, 2, "D")}
    assert turn_repair.repair_digests(turn_repair.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def _drawn(docs, target, n=1, buckets=50, least=3, percent=30):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = (Counter(b for x in side for b in features(x)[1]) for side in ([d[1] for d in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for doc_id, text in docs:
        words, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = order[: percent * len(order) // 100]
    return sorted((*r[:4], next((i + 1 for i, d in enumerate(drawn) if d is r), None)) for r in out if r[0] is not None), len(out)


@pytest.mark.parametrize("most_words", [1, 3])
def test_importance_beside_a_plain_version(spark, monkeypatch, most_words):
    monkeypatch.setattr(importance, "PIECE_BYTES", 300)
    rnd = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "élan", "x1", "naïve", "\x00odd", "snow☃man", "don't", "-"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, "beta " * 30_000), (None, "alpha beta gamma")]
    target = ["alpha alpha élan", None, "gamma don't"]
    frame = spark.createDataFrame([(*d, 1, 2.0, "c") for d in docs], "doc_id long, text string, row int, score double, counts string").repartition(5)
    found = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), most_words, 50, 3, 30).collect()
    want, n = _drawn(docs, target, most_words)
    assert sorted(tuple(r) for r in found if r.doc_id is not None) == want and len(found) == n


def test_importance_of_repeated_rows_and_nothing(spark):
    docs = spark.range(40).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"))
    target = spark.createDataFrame([], "text string")
    found = importance.resample(docs, target, least_words=3, percent=50).collect()
    assert len(found) == 40 and sorted(r.rank for r in found if r.rank) == list(range(1, 21)) and len({r.score for r in found}) == 1
    assert importance.resample(spark.createDataFrame([], "doc_id long, text string"), target).count() == 0
