"""Queries of text rules and timeline compression with their DuckDB equivalents, whose values are written out from the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text_rules
from ..operators import compression, episodes, incidents, templates
from .registry import _EV, ORACLE_SQL, _events, _query, _table

_CLASS = "regexp_extract(message, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1)"
_TEXTS = f"""{_EV}, t AS (SELECT *, {_CLASS} AS class, 'Caused by: ' || message AS root_cause, service || ' says ' || message AS long FROM ev)"""


@_query(rf"""WITH {_TEXTS} SELECT event_id, CASE WHEN class <> '' AND NOT contains(service, class) THEN service || ' | ' || class ELSE service END || ' | ' || root_cause AS semantic,
  CASE WHEN length(long) <= 40 THEN long ELSE rtrim(substr(long, 1, 39)) || '…' END AS short, CASE WHEN length(long) <= 30 THEN long ELSE substr(long, 1, 27) || '...' END AS compact,
  'Exception:' || CASE WHEN class <> '' THEN class ELSE substr(message, 1, 48) END AS node,
  service || '|' || level || '|' || CASE WHEN event_id % 3 = 0 THEN 'template:E1' ELSE substr(regexp_replace(regexp_replace(lower(message), '\b([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '<ip>', 'g'), '\b[0-9]+\b', '<num>', 'g'), 1, 320) END AS pattern_key,
  service || '::' || message || '::' || level AS feature FROM t""")
def event_texts(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumns({"root_cause": F.concat(F.lit("Caused by: "), "message"), "long": F.concat("service", F.lit("  says \t"), "message")})
    named = F.when(F.col("event_id") % 3 == 0, "E1")
    return rows.select(
        "event_id", text_rules.semantic_message(F.col("service"), F.col("exception_class"), F.col("root_cause")).alias("semantic"), text_rules.truncate(text_rules.first_said(F.lit(" "), F.col("long")), 40).alias("short"),
        text_rules.compact(F.col("long"), 30).alias("compact"), text_rules.exception_node(F.col("message")).alias("node"), text_rules.pattern_key(F.col("service"), F.col("level"), named, F.col("message")).alias("pattern_key"),
        text_rules.feature_name(F.col("service"), F.col("message"), F.col("level")).alias("feature"),
    )


@_query(rf"""WITH {_EV}, w AS (SELECT event_id, unnest(list_distinct(regexp_extract_all(lower(message), '[A-Za-z][A-Za-z0-9_.-]{{3,}}|[一-鿿]{{2,}}'))) AS word FROM ev)
  SELECT event_id, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n FROM w WHERE word NOT IN ('error', 'exception', 'failed', 'failure', '日志', '故障', '服务', '原因', '发生') GROUP BY event_id""")
def evidence_words(spark, sf_dir):
    words = F.array_sort(text_rules.evidence_tokens(F.col("message")))
    return _events(spark, sf_dir).select("event_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n")).filter("n > 0")


_SAID = "message || ' host=Node-' || CAST(user_id % 9 AS VARCHAR) || ' via http://10.1.2.' || CAST(user_id AS VARCHAR) || ':8080 and 300.1.1.1, db-' || CAST(user_id % 4 AS VARCHAR) || ':5432'"


@_query(rf"""WITH {_EV}, s AS (SELECT event_id, {_SAID} AS said FROM ev), a AS (
  SELECT event_id, unnest(list_concat(list_concat(regexp_extract_all(said, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?::[0-9]{{2,5}})?\b'), list_filter(regexp_extract_all(said, '\b[a-zA-Z][a-zA-Z0-9_.-]{{1,80}}:[0-9]{{2,5}}\b'), lambda x: NOT regexp_full_match(lower(x), 'https?:[0-9]+'))),
    regexp_extract_all(said, '(?i)\b(?:host|hostname|node|instance|endpoint|server|redis)\s*[=:]\s*([a-z0-9_.-]+(?::[0-9]{{2,5}})?)', 1))) AS e FROM s),
  i AS (SELECT event_id, list_distinct(list_filter(regexp_extract_all(said, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b'), lambda x: len(list_filter(string_split(x, '.'), lambda o: CAST(o AS INT) > 255)) = 0)) AS ips FROM s)
  SELECT event_id, string_agg(DISTINCT lower(e), ',' ORDER BY lower(e)) AS endpoints, (SELECT array_to_string(list_sort(ips), ',') FROM i WHERE i.event_id = a.event_id) AS ips FROM a GROUP BY event_id""")
def endpoint_names(spark, sf_dir):
    said = F.expr(_SAID.replace("VARCHAR", "STRING"))
    return _events(spark, sf_dir).select("event_id", F.array_join(text_rules.endpoint_tokens(said), ",").alias("endpoints"), F.array_join(F.array_sort(text_rules.ip_addresses(said)), ",").alias("ips"))


_CELLS = "CASE WHEN c_custkey % 3 = 0 THEN '[\"' || c_name || '\", \" \", \"x\"]' WHEN c_custkey % 3 = 1 THEN c_name || ' ,b；c, ;' ELSE '' END"
_CHAIN = "CASE WHEN c_custkey % 2 = 0 THEN '[\"a \", \"\", \"' || c_name || '\"]' ELSE 'a -> b->' || c_name END"
_MODE = "CASE c_custkey % 6 WHEN 0 THEN 'redis-cluster down' WHEN 1 THEN 'Connection Timeout' WHEN 2 THEN 'http 404' WHEN 3 THEN 'connect reset' WHEN 4 THEN '' ELSE ' Odd ' END"
_NAMED = "CASE WHEN c_custkey % 2 = 0 THEN 'project::p' || CAST(c_custkey % 7 AS VARCHAR) || '::' || c_name || '::x' ELSE c_name || ' Service' END"
_NOTE = "'user ' || c_name || ' password=' || CAST(c_custkey AS VARCHAR) || 'abc; api_key : k' || CAST(c_custkey AS VARCHAR) || ', token=t'"


@_query(rf"""WITH c AS (SELECT c_custkey, c_name, {_CELLS} AS cell, {_CHAIN} AS chain, {_MODE} AS mode, {_NAMED} AS named, {_NOTE} AS note, c_custkey % 100 / 100.0 AS confidence FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '|x' WHEN c_custkey % 3 = 1 THEN c_name || '|b|c' ELSE '' END AS items, CASE WHEN c_custkey % 2 = 0 THEN 'a|' || c_name ELSE 'a|b|' || c_name END AS chain,
  CASE c_custkey % 6 WHEN 0 THEN 'Redis 集群不可用' WHEN 1 THEN '下游连接超时' WHEN 2 THEN '接口资源不存在' WHEN 3 THEN '连接异常' WHEN 4 THEN '未分类故障' ELSE 'Odd' END AS label,
  CASE WHEN c_custkey % 2 = 0 THEN 'p' || (c_custkey % 7) ELSE '' END AS project, CASE WHEN c_custkey % 2 = 0 THEN c_name || '::x' ELSE c_name || ' Service' END AS shown,
  CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(lower(named), '[^a-z0-9]', '', 'g') ELSE regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') END AS norm,
  'user ' || c_name || ' password=<redacted>; api_key=<redacted>, token=<redacted>' AS note,
  CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM c""")
def name_rules(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", *(F.expr(x.replace("VARCHAR", "STRING")).alias(n) for n, x in (("cell", _CELLS), ("chain", _CHAIN), ("mode", _MODE), ("named", _NAMED), ("note", _NOTE))))
    project, shown = text_rules.project_and_name(F.col("named"))
    return rows.select(
        "c_custkey", F.array_join(text_rules.listed(F.col("cell")), "|").alias("items"), F.array_join(text_rules.chain(F.col("chain")), "|").alias("chain"), text_rules.fault_label(F.col("mode")).alias("label"),
        project.alias("project"), shown.alias("shown"), text_rules.entity_name(F.col("named")).alias("norm"), text_rules.redacted(F.col("note"), 500).alias("note"), text_rules.severity(F.col("c_custkey") % 100 / 100.0).alias("severity"),
    )


# --- timelines: the events of each fortieth user, in order ------------------------------------------------------------

_TL = f"""imp AS ({ORACLE_SQL['importance_scores']}), ev AS ({_EV.removeprefix('ev AS (')[:-1]}),
tl AS (SELECT ev.user_id % 40 AS key, row_number() OVER (PARTITION BY ev.user_id % 40 ORDER BY event_s, ev.event_id) - 1 AS place, level, service, signature, message, score FROM ev JOIN imp ON ev.event_id = imp.event_id)"""
_ANCHORS = f"""{_TL}, an AS (SELECT key, place FROM (SELECT key, place, row_number() OVER (PARTITION BY key ORDER BY score DESC, place) AS r FROM tl WHERE level IN ('FATAL', 'CRITICAL', 'ERROR') OR score >= 8) WHERE r <= 24),
en AS (SELECT key, min(place) AS lo, max(place) AS hi FROM tl GROUP BY key), pm AS (SELECT key, signature, count(*) AS n, min(place) AS lo, max(place) AS hi FROM tl GROUP BY key, signature HAVING count(*) > 1 AND max(score) >= 7),
ma AS (SELECT key, lo AS place, 'timeline_start' AS reason FROM en UNION SELECT key, hi, 'timeline_end' FROM en UNION SELECT key, lo, 'pattern_first' FROM pm UNION SELECT key, hi, 'pattern_last' FROM pm UNION SELECT key, place, 'failure_anchor' FROM an
  UNION SELECT an.key, an.place + d, CASE WHEN d < 0 THEN 'context_before_' ELSE 'context_after_' END || abs(d) FROM an, (VALUES (-2), (-1), (1), (2)) v(d) JOIN en ON en.key = an.key WHERE an.place + d BETWEEN en.lo AND en.hi)"""


def _timelines(spark, sf_dir):
    """The scored events in their timelines, checkpointed, as several choices are made of them."""
    scored = incidents.importance_scores(_events(spark, sf_dir)).withColumn("key", F.col("user_id") % 40)
    rows = scored.select("key", "event_s", "event_id", "level", "service", "signature", "message", "trace_id", "score")
    return compression.numbered(rows, "key", ["event_s", "event_id"]).select("key", "place", "event_id", "level", "service", "signature", "message", "trace_id", "score")


@_query(f"WITH {_ANCHORS} SELECT key, place, string_agg(reason, ',' ORDER BY reason) AS reasons FROM ma GROUP BY key, place")
def timeline_selection(spark, sf_dir):
    return compression.mandatory(_timelines(spark, sf_dir))


@_query(f"""WITH {_TL}, w AS (SELECT *, CASE level WHEN 'FATAL' THEN 13.0 WHEN 'ERROR' THEN 10.0 WHEN 'WARN' THEN 6.0 WHEN 'INFO' THEN 1.5 ELSE 0.4 END::DOUBLE AS weight,
    list_sum([CAST(regexp_matches(lower(message), p) AS INT) FOR p IN ['outofmemory|oom|java heap space|metaspace', 'deadlock|lock wait timeout', 'connection refused|connection reset|broken pipe|no route to host', 'rediscommandtimeoutexception|redisconnectionexception',
      'sqltransientconnectionexception|communicationsexception|hikaripool', 'timeout|timed out|deadline exceeded', 'circuit.?breaker.*open|service unavailable|bad gateway|gateway timeout', 'exception|\\berror\\b|failed|failure|panic|fatal', 'retry(ing)?|backoff|degraded|fallback']]) AS signals FROM tl),
  g AS (SELECT key, signature, count(*) AS n, min(place) AS first_place, max(place) AS last_place, arg_max(place, struct_pack(a := weight, b := signals, c := -place)) AS representative, max(weight) AS severity FROM w GROUP BY key, signature HAVING count(*) > 1),
  r AS (SELECT g.key, g.signature, n, first_place, last_place, tl.level, representative, round(2 * log2(n + 1) + severity, 6) AS priority FROM g JOIN tl ON tl.key = g.key AND tl.place = g.representative)
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, first_place) AS rank FROM r QUALIFY rank <= 12""")
def pattern_summaries(spark, sf_dir):
    return compression.pattern_summaries(_timelines(spark, sf_dir))


@_query(f"""WITH {_ANCHORS}, m AS (SELECT DISTINCT key, place FROM ma), f AS (SELECT tl.*, m.place IS NULL AS free FROM tl LEFT JOIN m ON m.key = tl.key AND m.place = tl.place),
  r AS (SELECT *, row_number() OVER (PARTITION BY key, signature ORDER BY free, score DESC, place) AS rank FROM f) SELECT key, place, signature, CASE WHEN rank <= 2 THEN rank END AS rank FROM r WHERE rank <= 2 OR NOT free""")
def pattern_tops(spark, sf_dir):
    rows = _timelines(spark, sf_dir)
    return compression.pattern_tops(rows, compression.mandatory(rows).select("key", "place"))


@_query(f"""WITH {_TL}, m AS (SELECT *, level IN ('FATAL', 'ERROR') AND place % 3 = 0 AS must FROM tl), c AS (SELECT key, count(*) FILTER (must) AS musts, count(*) FILTER (NOT must) AS rest FROM m GROUP BY key),
  s AS (SELECT *, least(greatest(20 - musts, 0), rest) AS slots FROM c), r AS (SELECT m.key, place, must, musts, rest, slots, row_number() OVER (PARTITION BY m.key, must ORDER BY place) - 1 AS rank FROM m JOIN s ON s.key = m.key),
  p AS (SELECT key, unnest([i * (rest - 1) // greatest(slots - 1, 1) FOR i IN range(slots)]) AS rank FROM s WHERE slots > 0)
  SELECT key, place FROM r WHERE musts + rest <= 20 OR CASE WHEN must THEN rank < 20 ELSE rank IN (SELECT rank FROM p WHERE p.key = r.key) END""")
def timeline_limited(spark, sf_dir):
    rows = _timelines(spark, sf_dir)
    return compression.limited(rows, rows.filter("level in ('FATAL', 'ERROR') and place % 3 = 0"), 20)


@_query(rf"""WITH {_EV}, rt AS (SELECT user_id % 40 AS key, min(event_s) AS root_s, min(event_id) AS first_id FROM ev WHERE level IN ('ERROR', 'FATAL') GROUP BY 1),
  j AS (SELECT ev.*, root_s, first_id, CASE ev.event_id % 7 WHEN 0 THEN 'root' WHEN 1 THEN 'Upstream_Effect' ELSE '' END AS role, {_CLASS} AS class, CASE WHEN user_id % 2 = 0 THEN 'timeoutexception' ELSE '' END AS named FROM ev LEFT JOIN rt ON rt.key = user_id % 40),
  b AS (SELECT *, coalesce(event_s = root_s, false) AS a, coalesce(event_id = first_id, false) AS b, named <> '' AND contains(lower(message), named) AS c FROM j)
  SELECT event_id, CASE level WHEN 'FATAL' THEN 120 WHEN 'ERROR' THEN 90 WHEN 'WARN' THEN 28 ELSE 0 END + CASE WHEN a THEN 140 ELSE 0 END + CASE WHEN b THEN 140 ELSE 0 END + CASE WHEN c THEN 100 ELSE 0 END + CASE WHEN role <> '' THEN 85 ELSE 0 END
    + CASE WHEN regexp_matches(lower(message), 'connection refused|connection reset|broken pipe|no route to host|outofmemory|oom|java heap space|metaspace|deadlock|lock wait timeout|timeout|timed out|deadline exceeded|disk full|no space left|unavailable|authentication failed|access denied|panic|fatal') THEN 75 ELSE 0 END
    + CASE WHEN contains(lower(message), 'connection') THEN 65 ELSE 0 END + CASE WHEN class <> '' THEN 30 ELSE 0 END AS relevance, a OR b OR c AS mandatory FROM b""")
def timeline_relevance(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("key", F.col("user_id") % 40)
    root = rows.filter("level in ('ERROR', 'FATAL')").groupBy("key").agg(F.min("event_s").alias("root_at"), F.array(F.min("event_id").cast("string")).alias("candidate_ids"))
    role = F.expr("case event_id % 7 when 0 then 'root' when 1 then 'Upstream_Effect' else '' end").alias("role")
    named = F.when(F.col("key") % 2 == 0, "TimeoutException").otherwise("").alias("root_exception")
    said = rows.join(root, "key", "left").select("event_id", "level", F.col("event_s").alias("at"), role, "message", F.lit(None).cast("string").alias("root_cause"), "exception_class", "root_at", named, "candidate_ids", F.array(F.lit("Connection"), F.lit("")).alias("candidate_texts"))
    return compression.relevance(said).select("event_id", "relevance", "mandatory")


@_query(f"""WITH rel AS ({ORACLE_SQL['timeline_relevance']}), ev AS ({_EV.removeprefix('ev AS (')[:-1]}), pl AS (SELECT ev.user_id % 40 AS key, row_number() OVER (PARTITION BY ev.user_id % 40 ORDER BY event_s, ev.event_id) - 1 AS place, relevance FROM ev JOIN rel ON rel.event_id = ev.event_id),
  ne AS (SELECT DISTINCT key, place + d AS place FROM pl, (SELECT unnest(range(-2, 3)) AS d) WHERE relevance > 0 AND (d = 0 OR relevance >= 50)) SELECT pl.key, pl.place FROM pl JOIN ne ON ne.key = pl.key AND ne.place = pl.place""")
def relevant_context(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "event_s", (F.col("user_id") % 40).alias("key"))
    placed = compression.numbered(rows.join(timeline_relevance(spark, sf_dir), "event_id"), "key", ["event_s", "event_id"])
    return compression.relevant_context(placed.select("key", "place", "relevance"))


# --- order-dependent operators: no SQL, tested beside plain loops -------------------------------------------------------


def _diverse(spark, sf_dir):
    rows = _timelines(spark, sf_dir)
    return rows, compression.diverse(rows, compression.mandatory(rows))


@_query()
def timeline_diverse(spark, sf_dir):
    return _diverse(spark, sf_dir)[1]


@_query()
def timeline_payload(spark, sf_dir):
    """The payload of each timeline, its shown events and repeated patterns, in 6000 characters."""
    rows, shown = _diverse(spark, sf_dir)
    counts = compression.pattern_members(rows).select("key", "signature", "n")
    events = rows.join(shown, ["key", "place"]).join(counts, ["key", "signature"]).select("key", F.struct(
        (F.col("place") + 1).alias("place"), F.col("score").alias("importance"), F.col("n").alias("occurrences"), "message", F.lit("").alias("root_cause"), F.concat_ws("|", "service", "level", "trace_id").alias("details")).alias("e"))
    patterns = compression.pattern_summaries(rows).select("key", F.struct("rank", F.col("signature").alias("message"), "n").alias("p"))
    sorted_of = lambda df, c, name: df.groupBy("key").agg(F.sort_array(F.collect_list(c)).alias(name))
    last = rows.groupBy("key").agg(F.count(F.lit(1)).alias("last"))
    whole = last.join(sorted_of(events, "e", "events"), "key").join(sorted_of(patterns, "p", "patterns"), "key", "left")
    whole = whole.withColumn("patterns", F.coalesce("patterns", F.array().cast(whole.schema["patterns"].dataType)))
    fit = compression.fit_budget(whole, 6000)
    return fit.select("key", F.size("events").cast("long").alias("n_events"), F.size("patterns").cast("long").alias("n_patterns"), F.col("size").cast("long").alias("chars"), F.to_json("events").alias("events"))


@_query()
def fault_episodes(spark, sf_dir):
    from ..functions import log_text

    errors = log_text.flagged(_events(spark, sf_dir)).filter("is_error")
    key = F.coalesce(F.when(F.col("root_exception_class") != "", F.col("root_exception_class")), "family")
    errors = errors.withColumns({"exception_key": key, "downstream": F.regexp_extract("message", r"downstream=([\w-]+)", 1)})
    return episodes.fault_episodes(errors.select("event_id", "event_s", "trace_id", "service", "downstream", "family", "exception_key", "is_wrapper", "is_atomic"))


@_query()
def message_templates(spark, sf_dir):
    """Templates by similarity alone."""
    return templates.mined(_events(spark, sf_dir), tree=False)[0]


@_query()
def template_tree(spark, sf_dir):
    """Templates by the prefix tree."""
    return templates.mined(_events(spark, sf_dir))[0]
