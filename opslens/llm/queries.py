"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, importance, line_dedup, ngram_join, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_counts, turn_repair
from .common import table

#: A conversation whose texts are made of other templates' control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(planted)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the lasting one that spark.opslens.tokenCache names, or a new one where it is unset."""
    cache = spark.conf.get("spark.opslens.tokenCache", None)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048, cache_path=cache)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("member")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), contents=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropped: the runs of lines that go, as (first, n) joined by commas."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join(F.transform("dropped", lambda r: F.concat_ws(":", r["first"], r["n"])), ","))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digests(turn_repair.damage(table(spark, sf_dir, "conversations")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_secret_scan, op3_token_counts, op4_quality_rules, op5_ngram_join, op6_substring_dedup, op7_bpe,
        op8_exact_dedup, op9_suffix_dedup, op10_packing, op11_line_dedup, op12_turn_repair, op13_importance, pipeline,
    )
}

_ESCAPED_CHARS = (
    lambda x: f"length({x}) + length({x}) - length(replace({x}, chr(92), ''))"
    + "".join(f" + (length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL)
)
_T, _S, _M, _E = (len(x) for x in (chat_format.TURN, chat_format.SAYS, chat_format.MORE, chat_format.END))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of a UTF-8 string, byte by byte: its table as CTEs, and the value by the string's hex digits h.
_CRC_TABLE = """crc_step AS (SELECT range AS n, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS steps FROM crc_step WHERE k = 8)"""
_CRC = """xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1]), 4294967295), 4294967295)"""
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{importance.WORD}')"
#: Costs of a turn from state 0 to 3, without inserted ones: to delete it, or to keep it or give it a role.
_TURN = [
    f"least(2 + after[{state + 1}], CASE WHEN held THEN more + least(1 + after[{to + 1}], {kept}) ELSE 1000000 END)"
    for state, to, kept in (
        (0, 2, "CASE initial WHEN 's' THEN after[2] WHEN 'u' THEN after[3] ELSE 1000000 END"),
        (1, 2, "CASE initial WHEN 'u' THEN after[3] ELSE 1000000 END"),
        (2, 3, "CASE initial WHEN 'a' THEN after[4] ELSE 1000000 END"),
        (3, 2, "CASE initial WHEN 'u' THEN after[3] ELSE 1000000 END"),
    )
]

ORACLE_SQL = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS DISTINCT FROM role OR i = 1 AS opens FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum({_ESCAPED_CHARS('text')} + CASE WHEN opens THEN {_T + _S + _E + 1} + {_ESCAPED_CHARS('role')} ELSE {_M} END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id""",
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)""",
    "op11_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT doc_id, line, i, coalesce(first < doc_id, false) AS gone FROM k LEFT JOIN f USING (key)),
r AS (SELECT doc_id, string_agg(first || ':' || n, ',' ORDER BY first) AS dropped FROM (
  SELECT doc_id, min(i) AS first, count(*) AS n FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j WHERE gone) GROUP BY doc_id, run) GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(any_value(dropped), '') AS dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
    "op12_turn_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
drawn AS (SELECT *, {_CRC} % 20 AS draw FROM (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h
  FROM conversations), crc_table),
damaged AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw != 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial,
    CASE WHEN trim(text, {_WHITE}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, {_WHITE}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    i > 1 AND lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
turns AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS held, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM judged),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
togo AS (
  SELECT conv_id, n + 1 AS i, [0, 10, 5, 0] AS v FROM sizes
  UNION ALL
  SELECT conv_id, i, [least(c[1], 5 + c[3], 10 + c[4]), least(c[2], 5 + c[3], 10 + c[4]), least(c[3], 5 + c[4]), least(c[4], 5 + c[3])] FROM (
    SELECT conv_id, i, [{", ".join(_TURN)}] AS c FROM (
      SELECT t.*, g.v AS after FROM togo g JOIN turns t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i - 1))),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS said, n FROM sizes
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN state WHEN 'K' THEN kept ELSE given END, audit || edit,
    CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE given WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END, n
  FROM (SELECT *, CASE WHEN i <= n AND now[state] = 2 + after[state] THEN 'D' WHEN now[state] = 5 + now[given] THEN 'I'
      WHEN kept > 0 AND now[state] = more + after[kept] THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT w.*, t.role, t.text, t.more, g.v AS now, a.v AS after, CASE state WHEN 3 THEN 4 ELSE 3 END AS given,
        CASE WHEN NOT held THEN 0 WHEN initial = 's' AND state = 1 THEN 2 WHEN initial = 'u' AND state != 3 THEN 3 WHEN initial = 'a' AND state = 3 THEN 4 ELSE 0 END AS kept
      FROM walk w JOIN togo g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i
      LEFT JOIN togo a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
      LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
      WHERE w.i <= w.n OR w.state IN (2, 3)))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id),
ends AS (SELECT w.conv_id, w.audit, w.said, g.v[1] AS cost FROM walk w JOIN togo g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = 1 WHERE w.i > w.n AND w.state IN (1, 4))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_importance": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
f AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
hashed AS (SELECT word, {_CRC} % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM b)), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT sum(s) FROM s) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM f JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
}
