"""All queries by name, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import log_text
from ..operators import graph, incidents, lineage, models, reports, time_windows
from ..sources import log_events

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL that queries share -------------------------------------------------------------------------------------------


def _has(words) -> str:
    return f"regexp_matches(lower(message), '{log_text.any_of(words)}')"


_FAMILY = "CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in log_text.FAMILIES) + " ELSE 'unknown' END"
_EV = f"ev AS ({log_events.DUCK_EVENTS})"
_F = f"""{_EV}, f0 AS (SELECT *, {_FAMILY} AS family, level IN ('ERROR', 'FATAL') AS is_error, {_has(log_text.ATOMIC)} AS is_atomic, {_has(log_text.WRAPPER)} AS is_wrapper FROM ev),
f AS (SELECT *, is_error AND (family IN ({', '.join(f"'{x}'" for x in log_text.TECHNICAL)}) OR is_atomic) AS is_technical FROM f0)"""
_COUNTS = f"""{_F}, w AS (SELECT *, unnest(generate_series(event_s // 60 * 60 - 240, event_s // 60 * 60, 60)) AS window_start FROM f),
c AS (SELECT window_start, window_start + 300 AS window_end, count(*) AS event_count, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS error_count,
  CAST(sum(CAST(is_technical AS INT)) AS BIGINT) AS technical_error_count, CAST(sum(CAST(is_atomic AS INT)) AS BIGINT) AS root_signal_count,
  count(DISTINCT service) AS n_services FROM w WHERE window_start >= (SELECT min(event_s) // 60 * 60 FROM f) GROUP BY window_start)"""
_FLAGS = f"""{_COUNTS}, g AS (SELECT *, technical_error_count > 0 OR root_signal_count > 0 AS is_anomaly,
  CASE WHEN technical_error_count > 0 AND root_signal_count > 0 THEN 'technical_error_rule+root_signal_rule' WHEN technical_error_count > 0 THEN 'technical_error_rule'
  WHEN root_signal_count > 0 THEN 'root_signal_rule' ELSE 'normal' END AS anomaly_reason FROM c)"""
_REGIONS = f"""{_FLAGS}, o AS (SELECT *, CASE WHEN window_start <= max(window_end) OVER (ORDER BY window_start, window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0 ELSE 1 END AS opens
  FROM g WHERE is_anomaly), i AS (SELECT *, CAST(sum(opens) OVER (ORDER BY window_start, window_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS region FROM o)"""
_MEMBERS = _REGIONS + """,
r AS (SELECT region, min(window_start) AS region_start, max(window_end) AS region_end FROM i GROUP BY region),
m AS (SELECT f.*, region, region_start, region_end FROM f JOIN r ON event_s >= region_start AND event_s < region_end)"""
_MASK = "message"
for _p in log_text.MASKS:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '<*>', 'g')"
_MASK = f"trim(regexp_replace({_MASK}, '\\s+', ' ', 'g'))"
_HOURS = f"""{_F}, h AS (SELECT event_s // 3600 * 3600 AS hour_s, count(*) AS events, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS errors, min(event_s) AS first_s, max(event_s) AS last_s FROM f GROUP BY 1)"""


def _events(spark, sf_dir) -> DataFrame:
    return log_events.from_table(spark, sf_dir)


def _windows(spark, sf_dir) -> DataFrame:
    return time_windows.flag_windows(time_windows.window_counts(_events(spark, sf_dir)))


def _regions(spark, sf_dir) -> DataFrame:
    """The regions, checkpointed, as they are few and what is asked of their members would plan them anew each time."""
    return lineage.cut(time_windows.anomaly_regions(_windows(spark, sf_dir)))


def _members(spark, sf_dir) -> DataFrame:
    return incidents.in_regions(_events(spark, sf_dir), _regions(spark, sf_dir))


# --- windows ----------------------------------------------------------------------------------------------------------


@_query(f"WITH {_COUNTS} SELECT * FROM c")
def window_counts(spark, sf_dir):
    return time_windows.window_counts(_events(spark, sf_dir))


@_query(f"""WITH {_F}, w AS (SELECT event_s // 60 * 60 - 60 * i AS window_start, service, trace_id, level IN ('ERROR', 'FATAL', 'WARN') AS signal FROM f, (SELECT unnest(range(5)) AS i)), v AS (SELECT * FROM w WHERE window_start >= (SELECT min(event_s) // 60 * 60 FROM f)),
  b AS (SELECT window_start, bool_or(signal) AS signals FROM v GROUP BY 1), x AS (SELECT v.* FROM v JOIN b ON b.window_start = v.window_start AND (signal OR NOT signals)), t AS (SELECT window_start, trace_id, count(*) AS n FROM x WHERE trace_id <> '' GROUP BY 1, 2),
  p AS (SELECT window_start, string_agg(trace_id, ',' ORDER BY n DESC, trace_id) AS trace_ids FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, trace_id) <= 10) GROUP BY 1)
  SELECT x.window_start, string_agg(DISTINCT service, ',' ORDER BY service) AS services, coalesce(any_value(trace_ids), '') AS trace_ids FROM x LEFT JOIN p ON p.window_start = x.window_start GROUP BY 1""")
def window_annotations(spark, sf_dir):
    return time_windows.window_annotations(_events(spark, sf_dir))


@_query(f"WITH {_FLAGS} SELECT * FROM g")
def window_flags(spark, sf_dir):
    return _windows(spark, sf_dir)


@_query(f"""WITH {_REGIONS} SELECT region, min(window_start) AS region_start, max(window_end) AS region_end, count(*) AS window_count, max(event_count) AS max_events,
  concat_ws('+', CASE WHEN max(root_signal_count) > 0 THEN 'root_signal_rule' END, CASE WHEN max(technical_error_count) > 0 THEN 'technical_error_rule' END) AS detection_source
  FROM i GROUP BY region""")
def anomaly_regions(spark, sf_dir):
    return time_windows.anomaly_regions(_windows(spark, sf_dir))


@_query(f"WITH {_HOURS} SELECT * FROM h")
def hour_buckets(spark, sf_dir):
    return time_windows.hour_buckets(_events(spark, sf_dir))


@_query(f"""WITH {_HOURS}, o AS (SELECT *, CASE WHEN hour_s - lag(hour_s) OVER (ORDER BY hour_s) <= 21600 THEN 0 ELSE 1 END AS opens FROM h),
  s AS (SELECT *, CAST(sum(opens) OVER (ORDER BY hour_s) AS BIGINT) AS segment FROM o)
  SELECT segment, min(first_s) AS start_s, max(last_s) AS end_s, CAST(sum(events) AS BIGINT) AS events, CAST(sum(errors) AS BIGINT) AS errors FROM s GROUP BY segment""")
def log_segments(spark, sf_dir):
    return time_windows.log_segments(time_windows.hour_buckets(_events(spark, sf_dir)))


@_query(f"""WITH {_HOURS}, p AS (SELECT hour_s AS peak_s FROM h ORDER BY errors DESC, events DESC, hour_s DESC LIMIT 1), a AS (SELECT min(first_s) AS lo, max(last_s) AS hi, sum(errors) AS e FROM h)
  SELECT peak_s, CASE WHEN e > 0 THEN greatest(lo, peak_s - 900) ELSE greatest(lo, hi - 86400) END AS start_s, CASE WHEN e > 0 THEN least(hi, peak_s + 4200) ELSE hi END AS end_s FROM p, a""")
def recommended_range(spark, sf_dir):
    return time_windows.recommended_range(time_windows.hour_buckets(_events(spark, sf_dir)))


@_query(f"WITH {_EV} SELECT level, count(*) AS n, min(event_s) AS first_s, max(event_s) AS last_s FROM ev GROUP BY level")
def precheck_profile(spark, sf_dir):
    return time_windows.level_profile(_events(spark, sf_dir))


# --- events -----------------------------------------------------------------------------------------------------------


@_query(f"WITH {_F} SELECT family, level, count(*) AS n FROM f GROUP BY family, level")
def fault_family_counts(spark, sf_dir):
    return log_text.flagged(_events(spark, sf_dir)).groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_F} SELECT event_id, level, family, message FROM f WHERE is_technical")
def technical_errors(spark, sf_dir):
    return log_text.flagged(_events(spark, sf_dir)).filter("is_technical").select("event_id", "level", "family", "message")


@_query(f"WITH {_F} SELECT event_id, level, message FROM f WHERE is_wrapper AND is_error")
def wrapper_errors(spark, sf_dir):
    return log_text.flagged(_events(spark, sf_dir)).filter("is_wrapper and is_error").select("event_id", "level", "message")


@_query(f"WITH {_EV} SELECT {_MASK} AS template, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY 1")
def masked_templates(spark, sf_dir):
    return incidents.masked_templates(_events(spark, sf_dir))


_PATTERN = "lower(message)"
for _p, _shown in (
    (r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}[T\s]\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"), (r"\b(?:0x)?[0-9a-f]{12,}\b", "<hex>"),
    (r"""([=:]\s*)['"]?[A-Za-z0-9_.:/-]{8,}['"]?""", r"\1<id>"), *[(r"(^|[^A-Za-z_0-9])[-+]?\d+(?:\.\d+)?(?:ms|s|m|h|kb|mb|gb|%)?($|[^A-Za-z_0-9])", r"\1<num>\2")] * 2,
):  # SQL has no look-around: a number takes the signs beside it along, and so every second of neighbours is left to a second turn
    _PATTERN = f"regexp_replace({_PATTERN}, '{_p.replace(chr(39), chr(39) * 2)}', '{_shown}', 'g')"
_PATTERN = f"trim(regexp_replace({_PATTERN}, '\\s+', ' ', 'g'))"


@_query(f"WITH {_EV} SELECT level, service, {_PATTERN} AS pattern, count(*) AS n, min(event_s) AS first_s, max(event_s) AS last_s FROM ev GROUP BY 1, 2, 3")
def pattern_frequency(spark, sf_dir):
    return incidents.pattern_frequency(_events(spark, sf_dir))


@_query(f"""WITH {_EV}, s AS (SELECT *, service || '|' || level || '|' || {_PATTERN} AS signature, regexp_matches(message, '[A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error)') AS named FROM ev),
  n AS (SELECT *, count(*) OVER (PARTITION BY signature) AS frequency, lower(message) AS t FROM s)
  SELECT event_id, signature, frequency, CASE level WHEN 'FATAL' THEN 13.0::DOUBLE WHEN 'ERROR' THEN 10.0::DOUBLE WHEN 'WARN' THEN 6.0::DOUBLE WHEN 'INFO' THEN 1.5::DOUBLE WHEN 'DEBUG' THEN 0.4::DOUBLE END
    + (CASE WHEN regexp_matches(t, 'outofmemory|oom|java heap space|metaspace') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, 'deadlock|lock wait timeout') THEN 9 ELSE 0 END
    + CASE WHEN regexp_matches(t, 'connection refused|connection reset|broken pipe|no route to host') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(t, 'rediscommandtimeoutexception|redisconnectionexception') THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(t, 'sqltransientconnectionexception|communicationsexception|hikaripool') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(t, 'timeout|timed out|deadline exceeded') THEN 6 ELSE 0 END
    + CASE WHEN regexp_matches(t, 'circuit.?breaker.*open|service unavailable|bad gateway|gateway timeout') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(t, 'exception|\\berror\\b|failed|failure|panic|fatal') THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, 'retry(ing)?|backoff|degraded|fallback') THEN 2 ELSE 0 END)::DOUBLE + 0.0::DOUBLE + CASE WHEN named THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END
    + least(4.0::DOUBLE, 4.0::DOUBLE / sqrt(frequency::DOUBLE)) + CASE WHEN trace_id <> '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM n""")
def importance_scores(spark, sf_dir):
    return incidents.importance_scores(_events(spark, sf_dir)).select("event_id", "signature", "frequency", "score")


@_query(f"""WITH {_EV}, s AS (SELECT service AS source, lead(service) OVER (PARTITION BY trace_id ORDER BY event_s, event_id) AS target FROM ev WHERE trace_id <> '')
  SELECT source, target, count(*) AS n FROM s WHERE target <> source GROUP BY source, target""")
def temporal_edges(spark, sf_dir):
    return incidents.temporal_edges(_events(spark, sf_dir))


@_query(f"WITH {_EV} SELECT trace_id, count(*) AS n, min(event_s) AS first_s, max(event_s) AS last_s, count(DISTINCT service) AS n_services FROM ev WHERE trace_id <> '' GROUP BY trace_id")
def trace_timeline(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("trace_id <> ''").groupBy("trace_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s"), F.count_distinct("service").alias("n_services"))


# --- incidents --------------------------------------------------------------------------------------------------------


@_query(f"WITH {_MEMBERS} SELECT region, event_id FROM m")
def region_members(spark, sf_dir):
    return _members(spark, sf_dir).select("region", "event_id")


@_query(f"WITH {_MEMBERS} SELECT event_id, level, service FROM f WHERE is_error AND event_id NOT IN (SELECT event_id FROM m)")
def unassigned_errors(spark, sf_dir):
    return incidents.unassigned_errors(_events(spark, sf_dir), _members(spark, sf_dir)).select("event_id", "level", "service")


_SCORED = _MEMBERS + """, k AS (SELECT *, regexp_extract(message, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1) AS class FROM m WHERE is_error),
e AS (SELECT *, coalesce(nullif(class, ''), family) AS exception_key, min(event_s) OVER (PARTITION BY region) AS start_s, count(*) OVER (PARTITION BY region, coalesce(nullif(class, ''), family)) AS same FROM k),
sc AS (SELECT *, round(CASE level WHEN 'FATAL' THEN 7.0::DOUBLE ELSE 5.0::DOUBLE END + CASE WHEN class <> '' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN is_atomic THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN is_wrapper THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END + greatest(0.0::DOUBLE, 3.0::DOUBLE - (event_s - start_s)::DOUBLE / 60.0::DOUBLE) + 3.0::DOUBLE / sqrt(same::DOUBLE), 6) AS score FROM e)"""


@_query(f"WITH {_SCORED} SELECT region, event_id, exception_key, score FROM sc")
def candidate_scores(spark, sf_dir):
    return incidents.candidate_scores(_members(spark, sf_dir)).select("region", "event_id", "exception_key", "score")


@_query(f"""WITH {_SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY region, exception_key ORDER BY score DESC, event_s, event_id) = 1 AS first FROM sc),
  p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY first DESC, score DESC, event_s, event_id) AS place FROM a) SELECT region, place, event_id, family, score FROM p WHERE place <= 30""")
def root_candidates(spark, sf_dir):
    return incidents.root_candidates(lineage.cut(incidents.candidate_scores(_members(spark, sf_dir))))


@_query(f"""WITH {_SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY region, exception_key ORDER BY score DESC, event_s, event_id) = 1 AS first FROM sc),
  top AS (SELECT region, event_id FROM a QUALIFY row_number() OVER (PARTITION BY region ORDER BY first DESC, score DESC, event_s, event_id) = 1), sp AS (SELECT region, min(event_s) AS lo, max(event_s) AS hi FROM sc GROUP BY region),
  tr AS (SELECT DISTINCT region, trace_id, region_start, region_end FROM sc WHERE trace_id <> ''), al AS (SELECT region, event_id, is_error FROM sp JOIN f ON event_s BETWEEN lo - 60 AND hi + 120
    UNION SELECT region, event_id, is_error FROM tr JOIN f ON f.trace_id = tr.trace_id AND event_s >= region_start AND event_s < region_end UNION SELECT region, event_id, true FROM sc)
  SELECT al.region, al.event_id, CASE WHEN top.event_id IS NOT NULL THEN 'root_candidate' WHEN sc.event_id IS NOT NULL THEN 'error' WHEN al.is_error THEN 'related_error' ELSE 'context' END AS role
  FROM al LEFT JOIN sc ON sc.region = al.region AND sc.event_id = al.event_id LEFT JOIN top ON top.region = al.region AND top.event_id = al.event_id""")
def context_join(spark, sf_dir):
    """The events of each region's incident with their roles; its errors are the primary ones."""
    regions = _regions(spark, sf_dir)
    scored = lineage.cut(incidents.candidate_scores(incidents.in_regions(_events(spark, sf_dir), regions)))
    return incidents.incident_context(_events(spark, sf_dir), regions, scored, incidents.root_candidates(scored))


@_query(f"""WITH {_SCORED} SELECT region, exception_key, count(*) AS n, min(event_s) AS first_s, max(event_s) AS last_s, count(DISTINCT service) AS n_services,
  count(DISTINCT CASE WHEN trace_id <> '' THEN trace_id END) AS n_traces, arg_min(event_id, struct_pack(a := -score, b := event_s, c := event_id)) AS representative FROM sc GROUP BY region, exception_key""")
def exception_summary(spark, sf_dir):
    return incidents.exception_summary(incidents.candidate_scores(_members(spark, sf_dir)))


@_query(f"""WITH {_MEMBERS}, t AS (SELECT region, trace_id, count(*) AS n FROM m WHERE trace_id <> '' GROUP BY region, trace_id),
  p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, trace_id) AS place FROM t) SELECT region, trace_id, n FROM p WHERE place <= 10""")
def top_traces(spark, sf_dir):
    return incidents.top_traces(_members(spark, sf_dir))


@_query(f"""WITH {_F}, e AS (SELECT family AS mode, service, count(*) AS n FROM f WHERE is_error GROUP BY 1, 2)
  SELECT mode, CAST(sum(n) AS BIGINT) AS n, count(*) AS services, max(struct_pack(n := n, s := service)).s AS top_service FROM e GROUP BY mode""")
def fault_mode_distribution(spark, sf_dir):
    return reports.fault_modes(log_text.flagged(_events(spark, sf_dir)).filter("is_error"), "family")


# --- graph ------------------------------------------------------------------------------------------------------------


def static_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions contain nations, nations have suppliers as members, customers call suppliers that their orders name."""
    t = lambda name: _table(spark, sf_dir, name)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda table, p, c, n, kind: t(table).select(name(p, c).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("kind"))
    nodes = node("region", "r:", "r_regionkey", "r_name", "System").unionByName(node("nation", "n:", "n_nationkey", "n_name", "Cluster"))
    nodes = nodes.unionByName(node("supplier", "s:", "s_suppkey", "s_name", "Instance")).unionByName(node("customer", "c:", "c_custkey", "c_name", "Service"))
    edge = lambda table, a, b, kind: table.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    calls = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    edges = edge(t("nation"), name("r:", "n_regionkey"), name("n:", "n_nationkey"), "CONTAINS").unionByName(edge(t("supplier"), name("n:", "s_nationkey"), name("s:", "s_suppkey"), "HAS_MEMBER"))
    return nodes, edges.unionByName(edge(calls, name("c:", "o_custkey"), name("s:", "l_suppkey"), "CALLS"))


_GRAPH = """nodes AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, 'System' AS kind FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Cluster' FROM nation
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'Instance' FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name, 'Service' FROM customer),
edges AS (SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'CONTAINS' AS type FROM nation UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'HAS_MEMBER' FROM supplier
  UNION ALL SELECT DISTINCT 'c:' || o_custkey, 's:' || l_suppkey, 'CALLS' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@_query(f"WITH {_GRAPH} SELECT 'kind' AS item, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type")
def graph_overview(spark, sf_dir):
    return graph.overview(*static_graph(spark, sf_dir))


@_query(f"WITH {_GRAPH} SELECT * FROM edges")
def static_edges(spark, sf_dir):
    return static_graph(spark, sf_dir)[1]


@_query(f"WITH {_GRAPH} SELECT * FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def orphan_nodes(spark, sf_dir):
    return graph.orphan_nodes(*static_graph(spark, sf_dir))


@_query(f"""WITH {_GRAPH}, few AS (SELECT * FROM nodes WHERE kind <> 'Cluster')
  SELECT source, target, type, source IN (SELECT id FROM few) AS has_source, target IN (SELECT id FROM few) AS has_target FROM edges
  WHERE NOT (source IN (SELECT id FROM few) AND target IN (SELECT id FROM few))""")
def dangling_edges(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    return graph.dangling_edges(nodes.filter("kind <> 'Cluster'"), edges)


@_query("""SELECT 'c:' || o_custkey AS source, 's:' || l_suppkey AS target, 'CALLS' AS type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_edges(spark, sf_dir):
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    calls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("CALLS").alias("type")
    )
    return graph.duplicate_edges(calls)


@_query(f"WITH {_GRAPH} SELECT source AS parent, count(DISTINCT target) AS n_members FROM edges WHERE type IN ('HAS_MEMBER', 'CONTAINS') GROUP BY source")
def cluster_members(spark, sf_dir):
    return graph.member_counts(static_graph(spark, sf_dir)[1])


def _search_sql(a: str, b: str, seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT id AS seed, id AS node, CAST(0 AS BIGINT) AS distance FROM nodes WHERE {seeds}
  UNION SELECT seed, {b}, distance + 1 FROM b JOIN edges ON {a} = node WHERE distance < {depth}) SELECT seed, node, min(distance) AS distance FROM b GROUP BY seed, node"""


@_query(_search_sql("source", "target", "kind = 'System'", 3))
def bfs_forward(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    return graph.bounded_search(edges, nodes.filter("kind = 'System'"), 3)


@_query(_search_sql("target", "source", "id IN ('s:1', 's:2', 's:3')", 3))
def bfs_reverse(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    return graph.bounded_search(edges, nodes.filter("id in ('s:1', 's:2', 's:3')"), 3, reverse=True)


@_query(f"WITH {_GRAPH}, k AS (SELECT id FROM nodes WHERE kind IN ('Cluster', 'Instance')) SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def incident_subgraph(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    return graph.induced(edges, nodes.filter("kind in ('Cluster', 'Instance')").select("id"))


@_query("""SELECT 'n:' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Cluster' ELSE 'Service' END AS kind FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, lower(r_name), 'Service' FROM region""")
def graph_merge(spark, sf_dir):
    nodes = static_graph(spark, sf_dir)[0]
    even = F.substring("id", 3, 20).cast("int") % 2 == 0
    left = nodes.filter("kind = 'Cluster'").select("id", F.when(even, F.col("name")).otherwise("").alias("name"), F.when(even, F.col("kind")).otherwise("Component").alias("kind"))
    right = nodes.filter("kind in ('Cluster', 'System')").select("id", F.lower("name").alias("name"), F.lit("Service").alias("kind"))
    return graph.merge_nodes(left, right)


@_query("""SELECT n_name || ' service' AS name, min('n:' || n_nationkey) AS id FROM nation GROUP BY n_name UNION ALL SELECT 'nowhere', NULL""")
def entity_resolution(spark, sf_dir):
    nodes = static_graph(spark, sf_dir)[0]
    names = nodes.filter("kind = 'Cluster'").select(F.concat("name", F.lit(" service")).alias("name")).unionByName(spark.range(1).select(F.lit("nowhere").alias("name")))
    return graph.resolve_entities(names, nodes)


@_query(f"""WITH {_F}, s AS (SELECT service AS node, CASE WHEN is_atomic THEN 0.5::DOUBLE WHEN is_technical THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END + CASE WHEN is_wrapper THEN 0.0::DOUBLE ELSE 0.125::DOUBLE END AS score FROM f WHERE is_error),
  a AS (SELECT node, least(0.98::DOUBLE, max(score) + least(0.09::DOUBLE, 0.03::DOUBLE * (count(*) - 1))) AS score, count(*) AS n FROM s GROUP BY node)
  SELECT node, score, n, row_number() OVER (ORDER BY score DESC, node) AS rank, CASE WHEN score >= 0.75 THEN 'probable' WHEN score >= 0.5 THEN 'suspected' ELSE 'weak' END AS status FROM a QUALIFY rank <= 5""")
def rca_scores(spark, sf_dir):
    errors = log_text.flagged(_events(spark, sf_dir)).filter("is_error")
    score = F.when(F.col("is_atomic"), 0.5).when(F.col("is_technical"), 0.4).otherwise(0.25) + F.when(F.col("is_wrapper"), 0.0).otherwise(0.125)
    return graph.rank_hypotheses(graph.candidate_nodes(errors.select(F.col("service").alias("node"), score.alias("score"))))


# --- reports ----------------------------------------------------------------------------------------------------------

_ORDERS = """inc AS (SELECT o_orderkey AS id, o_custkey % 50 AS project, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE o_orderstatus END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'none' END AS severity,
  o_orderpriority AS root, o_orderdate AS created FROM orders)"""


def _incidents(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise(F.col("o_orderstatus"))
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").when(first == "4", "low").otherwise("none")
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("project"), status.alias("status"), severity.alias("severity"), F.col("o_orderpriority").alias("root"), F.col("o_orderdate").alias("created")
    )


@_query(f"""WITH {_ORDERS}, k AS (SELECT CASE WHEN severity = 'none' THEN 'medium' ELSE severity END AS severity, CASE WHEN status IN ('open', 'in_progress', 'resolved', 'ignored') THEN status ELSE 'open' END AS status FROM inc),
  d AS (SELECT s.severity, t.status FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) s(severity), (VALUES ('open'), ('in_progress'), ('resolved'), ('ignored')) t(status))
  SELECT d.severity, d.status, count(k.severity) AS n FROM d LEFT JOIN k ON d.severity = k.severity AND d.status = k.status GROUP BY d.severity, d.status""")
def severity_status_dist(spark, sf_dir):
    return reports.severity_status(_incidents(spark, sf_dir))


@_query(f"""WITH {_ORDERS} SELECT project, count(*) AS total, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (status = 'resolved') AS resolved FROM inc GROUP BY project""")
def batch_severity(spark, sf_dir):
    return reports.batch_severity(_incidents(spark, sf_dir))


@_query(f"""WITH {_ORDERS} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(DISTINCT project) AS projects,
  CAST(1000 * count(*) FILTER (status = 'resolved') // count(*) AS BIGINT) AS resolved_per_1000 FROM inc""")
def report_summary(spark, sf_dir):
    return reports.summary(_incidents(spark, sf_dir))


@_query(f"""WITH {_ORDERS}, k AS (SELECT *, row_number() OVER (ORDER BY created DESC, id DESC) AS place, count(*) OVER () AS total FROM inc WHERE severity = 'high')
  SELECT place, id, status, severity, total, CAST(ceil(total / 10.0) AS BIGINT) AS pages FROM k WHERE place BETWEEN 11 AND 20""")
def incident_page(spark, sf_dir):
    return reports.page(_incidents(spark, sf_dir), number=2, size=10, severity="high")


@_query(f"""WITH {_ORDERS}, k AS (SELECT *, row_number() OVER (ORDER BY created DESC, id DESC) AS place, count(*) OVER () AS total FROM inc WHERE status = 'open' AND CAST(id AS VARCHAR) ILIKE '%1_3%')
  SELECT place, id, status, severity, total, CAST(ceil(total / 10.0) AS BIGINT) AS pages FROM k WHERE place <= 10""")
def incident_search(spark, sf_dir):
    return reports.page(_incidents(spark, sf_dir).select("id", "status", "severity", "created"), number=1, size=10, status="open", like=" 1_3 ")


@_query(f"WITH {_ORDERS} SELECT id, project, status FROM inc ORDER BY created DESC, id DESC LIMIT 8")
def recent_incidents(spark, sf_dir):
    return _incidents(spark, sf_dir).orderBy(F.col("created").desc(), F.col("id").desc()).limit(8).select("id", "project", "status")


@_query("""WITH h AS (SELECT l_orderkey AS id, 'p:' || l_partkey AS node, 1 AS root, 0 AS chain FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT DISTINCT l_orderkey, 's:' || l_suppkey, 0, 1 FROM lineitem)
  SELECT node, CAST(sum(root) AS BIGINT) AS root_hits, CAST(sum(chain) AS BIGINT) AS chain_hits, count(DISTINCT id) AS incidents FROM h GROUP BY node""")
def node_frequency(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    roots = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("node"))
    return reports.node_frequency(roots, lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("node")))


@_query("""WITH f AS (SELECT l_orderkey AS id, l_returnflag AS node, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), p AS (SELECT id, string_agg(node, '->' ORDER BY place, node) AS path FROM f GROUP BY id)
  SELECT path, count(*) AS n FROM p GROUP BY path""")
def path_frequency(spark, sf_dir):
    return reports.path_frequency(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("node")))


@_query(f"""WITH {_ORDERS} SELECT id, CASE WHEN id % 3 = 0 THEN status ELSE 'open' END AS status, CASE WHEN id % 2 = 1 THEN 'critical' ELSE severity END AS severity FROM inc WHERE id % 3 = 0 OR id % 2 = 1""")
def incident_upsert(spark, sf_dir):
    rows = _incidents(spark, sf_dir).select("id", "status", "severity")
    new = rows.filter("id % 2 = 1").select("id", F.lit("open").alias("status"), F.lit("critical").alias("severity"))
    return reports.upsert(rows.filter("id % 3 = 0"), new, "id", keep=("status",))


# --- models -----------------------------------------------------------------------------------------------------------


@_query("""WITH l AS (SELECT vec_id AS row, unnest(range(len(embedding))) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings), s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS deviation FROM l GROUP BY feature)
  SELECT row, CAST(feature AS INT) AS feature, round(CASE WHEN deviation > 0 THEN (value - mean) / deviation ELSE 0.0 END, 6) AS z FROM l JOIN s USING (feature)""")
def zscore(spark, sf_dir):
    long = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("feature", "value"))
    return models.zscores(long.withColumn("value", F.col("value").cast("double"))).select("row", "feature", F.round("z", 6).alias("z"))


@_query()
def principal_components(spark, sf_dir):
    found, shares = models.reduced(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumn("explained", F.lit(sum(shares)))


@_query()
def isolation_forest(spark, sf_dir):
    found, _ = models.reduced(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return models.contaminated(models.isolation_scores(found, "vec_id", "vector"))


@_query()
def one_class_svm(spark, sf_dir):
    found, _ = models.reduced(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    scored = models.one_class_scores(lineage.cut(found), "vec_id", "vector")
    return scored.withColumn("is_anomaly", F.col("score") > 0)


from . import architecture_queries, decision_queries, graph_queries, grounding_queries, incident_graph_queries, incident_queries, loose_json_queries, runbook_queries, text_queries  # noqa: E402, F401  put their queries in
