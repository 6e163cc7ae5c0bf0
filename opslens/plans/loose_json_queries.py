"""Queries of JSON of unknown shape with their DuckDB equivalents, over answers made of customers and their comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import loose_json
from .registry import _query, _table

_ANSWER = """CASE c_custkey % 5 WHEN 0 THEN '<think>{"x": 1}</think>```json' || chr(10) || '{"name": "' || c_name || '", "key": ' || c_custkey || ', "gone": {"a": null, "b": [], "c": {"d": ""}}}' || chr(10) || '```'
  WHEN 1 THEN 'Answer: {"name": "' || c_name || '", "key": ' || c_custkey || ', "l": [null, {"a": {"b": {"c": "deep"}}, "e": ""}],} end' WHEN 2 THEN replace('{~name~: ~' || c_name || '~, key: ' || c_custkey || ', "ok": True}', '~', chr(39))
  WHEN 3 THEN '{"name": "' || c_name || '", "in": {"key": ' || c_custkey || ', "p": [" a ", {"q": 1}' ELSE 'no object for ' || c_name END"""
_ROWS = "WITH c AS (SELECT c_custkey, c_name, c_custkey % 5 AS k, '\"key\":' || c_custkey AS key, '\"name\":\"' || c_name || '\"' AS name FROM customer)"


def _answers(spark, sf_dir):
    """The parsed answers, without those that hold no object."""
    return _table(spark, sf_dir, "customer").select("c_custkey", loose_json.lenient(F.expr(_ANSWER)).alias("v")).filter("v is not null")


@_query(_ROWS + """ SELECT c_custkey, CASE k WHEN 0 THEN '{"gone":{"a":null,"b":[],"c":{"d":""}},' || key || ',' || name || '}' WHEN 1 THEN '{' || key || ',"l":[null,{"a":{"b":"<truncated>"},"e":""}],' || name || '}'
  WHEN 2 THEN '{' || key || ',' || name || ',"ok":true}' ELSE '{"in":{' || key || ',"p":["a",{"q":"<truncated>"}]},' || name || '}' END AS bounded FROM c WHERE k < 4""")
def bounded_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("c_custkey", F.to_json(loose_json.bounded(F.col("v"))).alias("bounded"))


@_query(_ROWS + """ SELECT c_custkey, CASE k WHEN 0 THEN '{' || key || ',' || name || '}' WHEN 1 THEN '{' || key || ',"l":[null,{"a":{"b":{"c":"deep"}}}],' || name || '}'
  WHEN 2 THEN '{' || key || ',' || name || ',"ok":true}' ELSE '{"in":{' || key || ',"p":[" a ",{"q":1}]},' || name || '}' END AS kept FROM c WHERE k < 4""")
def answers_without_empty(spark, sf_dir):
    return _answers(spark, sf_dir).select("c_custkey", F.to_json(loose_json.without_empty(F.col("v"))).alias("kept"))


@_query(_ROWS + """ SELECT c_custkey, CASE k WHEN 0 THEN '|' || c_custkey || '|' || c_name WHEN 1 THEN c_custkey || '||' || c_name WHEN 2 THEN c_custkey || '|' || c_name || '|True' ELSE c_custkey || '| a |' || c_name END AS said FROM c WHERE k < 4""")
def answer_texts(spark, sf_dir):
    return _answers(spark, sf_dir).select("c_custkey", F.array_join(loose_json.texts(F.col("v")), "|").alias("said"))
