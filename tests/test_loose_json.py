"""JSON of unknown shape beside plain recursion over parsed objects."""

import json
import random

from pyspark.sql import functions as F

from opslens.functions import loose_json


def plain_bounded(v, depth=0):
    if depth >= 4:
        return "<truncated>"
    if isinstance(v, str):
        v = v.strip(" ")
        return v if len(v) <= 900 else v[:899] + "…"
    if isinstance(v, list):
        return [plain_bounded(x, depth + 1) for x in v[:12]]
    return {k: plain_bounded(v[k], depth + 1) for k in sorted(v)[:24]} if isinstance(v, dict) else v


def plain_kept(v):
    if isinstance(v, dict):
        kept = {k: plain_kept(x) for k, x in v.items()}
        return {k: x for k, x in kept.items() if x is not None and x != "" and x != [] and x != {}}
    return [plain_kept(x) for x in v] if isinstance(v, list) else v


def plain_texts(v, depth=0):
    if depth > 3 or v is None:
        return []
    if isinstance(v, str):
        return [v[:4000]]
    if isinstance(v, dict):
        return [t for k in sorted(v)[:24] for t in plain_texts(v[k], depth + 1)]
    return [t for x in v[:120] for t in plain_texts(x, depth + 1)] if isinstance(v, list) else [str(v)]


def made(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice([None, "", " a ", "x" * 950, 7, True, [], {}, "{1}", "[]"])
    if rnd.random() < 0.5:
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(16 if depth > 3 else 4))]
    return {f"k{rnd.randrange(40)}": made(rnd, depth - 1) for _ in range(rnd.randrange(30 if depth > 3 else 4))}


def test_nested_values(spark):
    rnd = random.Random(3)
    values = [{"top": made(rnd, rnd.randrange(6))} for _ in range(40)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, text string")
    rows, v = rows.select("id", loose_json.lenient(F.col("text")).alias("v")), F.col("v")
    got = rows.select("id", F.to_json(loose_json.bounded(v)).alias("b"), F.to_json(loose_json.without_empty(v)).alias("k"), loose_json.texts(v).alias("t")).collect()
    for r in got:
        assert json.loads(r.b) == plain_bounded(values[r.id])
        assert json.loads(r.k) == plain_kept(values[r.id])
        assert r.t == plain_texts(values[r.id])


def test_lenient(spark):
    cases = [
        ('<think>{"no": 1}</think>\n```json\n{"a": [1, {"b": null}]}\n```', {"a": [1, {"b": None}]}), ('so: {"a": 1,} ok', {"a": 1}), ("{'a': True, 'b': [None, 'x',]}", {"a": True, "b": [None, "x"]}),
        ('{a: 1, b_c: "d: e, f: g"}', {"a": 1, "b_c": "d: e, f: g"}), ('{"a": {"b": [1, {"c": 2}', {"a": {"b": [1, {"c": 2}]}}), ('{"a": "keeps ,] and True"}', {"a": "keeps ,] and True"}),
        ("no object", None), ("} {", None), ("", None), (None, None), ("[1, 2]", None), ('{"a" 1}', None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    got = {r.id: r.j for r in rows.select("id", F.to_json(loose_json.lenient(F.col("text"))).alias("j")).collect()}
    assert [got[i] and json.loads(got[i]) for i in range(len(cases))] == [want for _, want in cases]


def test_nothing(spark):
    rows = spark.createDataFrame([], "text string")
    rows, v = rows.select(loose_json.lenient(F.col("text")).alias("v")), F.col("v")
    assert rows.select(F.to_json(loose_json.bounded(v)), loose_json.texts(v)).collect() == []
