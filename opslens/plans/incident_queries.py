"""Queries of features, incident records and reports with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text_rules
from ..operators import incidents, lineage, reports, time_windows
from .registry import _COUNTS, _EV, _FLAGS, _MASK, _MEMBERS, _ORDERS, _SCORED, _events, _incidents, _members, _query, _regions, _table, _windows

_FEATURES = f"""{_EV}, t AS (SELECT event_s // 60 * 60 AS step, service || '::' || {_MASK} AS feature, count(*) AS n FROM ev GROUP BY 1, 2), w AS (SELECT step - 60 * i AS window_start, feature, n FROM t, (SELECT unnest(range(5)) AS i)),
fw AS (SELECT window_start, feature, CAST(sum(n) AS BIGINT) AS n FROM w WHERE window_start >= (SELECT min(step) FROM t) GROUP BY 1, 2), ids AS (SELECT window_start, printf('W%06d', row_number() OVER (ORDER BY window_start)) AS window_id FROM fw GROUP BY window_start HAVING sum(n) >= 2),
ft AS (SELECT window_id, fw.window_start, feature, n FROM fw JOIN ids ON ids.window_start = fw.window_start)"""


@_query(f"WITH {_FEATURES} SELECT * FROM ft")
def window_features(spark, sf_dir):
    return time_windows.window_features(_events(spark, sf_dir), min_events=2)


@_query(f"""WITH {_FEATURES}, s AS (SELECT feature, sum(n)::DOUBLE / (SELECT count(*) FROM ids) AS mean, sum(n * n)::DOUBLE / (SELECT count(*) FROM ids) AS squares FROM ft GROUP BY feature),
  z AS (SELECT window_id, feature, n, round(CASE WHEN squares - mean * mean > 0 THEN (n - mean) / sqrt(squares - mean * mean) ELSE 0 END, 6) AS z FROM ft JOIN s USING (feature))
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(z) DESC, feature) AS place FROM z QUALIFY place <= 3""")
def window_contributors(spark, sf_dir):
    return time_windows.contributors(time_windows.window_features(_events(spark, sf_dir), min_events=2), most=3)


@_query(f"""WITH {_EV}, t AS (SELECT service || '::' || {_MASK} AS feature, count(*) FILTER (user_id % 3 = 0) AS n_train, count(*) FILTER (user_id % 3 <> 0) AS n_target FROM ev GROUP BY 1) SELECT * FROM t""")
def feature_alignment(spark, sf_dir):
    rows = _events(spark, sf_dir)
    counted = lambda part: time_windows.window_features(part, size=60).groupBy("feature").agg(F.sum("n").alias("n"))
    return time_windows.aligned_features(counted(rows.filter("user_id % 3 = 0")), counted(rows.filter("user_id % 3 <> 0")))


@_query(f"WITH {_COUNTS}, b AS (SELECT window_start FROM c WHERE error_count * 3 > event_count) SELECT event_id, level FROM ev WHERE EXISTS (SELECT 1 FROM b WHERE event_s >= window_start AND event_s < window_start + 300)")
def model_supported(spark, sf_dir):
    return time_windows.in_windows(_events(spark, sf_dir), _windows(spark, sf_dir).filter("error_count * 3 > event_count")).select("event_id", "level")


@_query(f"""WITH {_FLAGS}, b AS (SELECT window_start FROM c WHERE error_count * 3 > event_count) SELECT window_start, b.window_start IS NOT NULL OR is_anomaly AS is_anomaly,
  CASE WHEN b.window_start IS NULL THEN anomaly_reason WHEN anomaly_reason = 'normal' THEN 'model' ELSE 'model+' || anomaly_reason END AS anomaly_reason FROM g LEFT JOIN b USING (window_start)""".replace("g LEFT JOIN b USING (window_start)", "g LEFT JOIN b ON b.window_start = g.window_start").replace("SELECT window_start, b", "SELECT g.window_start, b"))
def model_or_rules(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return time_windows.with_model(windows, windows.filter("error_count * 3 > event_count").select("window_start")).select("window_start", "is_anomaly", "anomaly_reason")


_CANDIDATES = f"""{_SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY region, exception_key ORDER BY score DESC, event_s, event_id) = 1 AS first FROM sc),
cd AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY first DESC, score DESC, event_s, event_id) AS place FROM a)"""


def _first(spark, sf_dir):
    members = _members(spark, sf_dir)
    return members, incidents.root_candidates(lineage.cut(incidents.candidate_scores(members)))


@_query(f"""WITH {_CANDIDATES}, x AS (SELECT region, trace_id, count(*) AS n FROM m WHERE trace_id <> '' GROUP BY 1, 2), q AS (SELECT region, arg_min(trace_id, struct_pack(a := -n, b := trace_id)) AS primary_trace FROM x GROUP BY region),
  y AS (SELECT region, min(event_s) AS fault_start, max(event_s) AS fault_end, count(*) AS n_events, count(*) FILTER (is_error) AS n_errors, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(DISTINCT trace_id) FILTER (trace_id <> '') AS n_traces FROM m GROUP BY region)
  SELECT y.*, primary_trace, event_id AS root_event, family AS root_family, printf('I%05d', row_number() OVER (ORDER BY fault_start, fault_end, y.region)) AS incident FROM y LEFT JOIN q ON q.region = y.region LEFT JOIN cd ON cd.region = y.region AND place = 1""")
def incident_rows(spark, sf_dir):
    return incidents.incident_rows(*_first(spark, sf_dir))


@_query(f"""WITH {_CANDIDATES}, x AS (SELECT region, trace_id, count(*) AS n FROM m WHERE trace_id <> '' GROUP BY 1, 2), q AS (SELECT region, arg_min(trace_id, struct_pack(a := -n, b := trace_id)) AS primary_trace FROM x GROUP BY region),
  y AS (SELECT region, min(event_s) AS fault_start, max(event_s) AS fault_end, count(*) AS event_count, count(*) FILTER (is_error) AS error_count, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(DISTINCT trace_id) FILTER (trace_id <> '') AS n_traces,
    arg_min(struct_pack(service, message), struct_pack(a := event_s, b := event_id)) AS opening FROM m GROUP BY region),
  z AS (SELECT region, min(window_start) AS detected_start, max(window_end) AS detected_end, count(*) AS window_count, concat_ws('+', CASE WHEN max(root_signal_count) > 0 THEN 'root_signal_rule' END, CASE WHEN max(technical_error_count) > 0 THEN 'technical_error_rule' END) AS detection_source FROM i GROUP BY region),
  ek AS (SELECT region, exception_key, count(*) AS n FROM sc GROUP BY 1, 2), ec AS (SELECT region, count(*) AS exception_class_count, string_agg(exception_key, ',' ORDER BY n DESC, exception_key) AS exception_classes FROM ek GROUP BY region)
  SELECT printf('I%05d', row_number() OVER (ORDER BY fault_start, fault_end, y.region)) AS incident, fault_start AS start, fault_end AS "end", detected_start, detected_end, fault_start, fault_end, 0.0::DOUBLE AS max_score, window_count, event_count, error_count,
    coalesce(exception_class_count, 0) AS exception_class_count, coalesce(exception_classes, '') AS exception_classes, services, n_traces, coalesce(primary_trace, '') AS primary_trace, coalesce(cd.service, opening.service) AS root_service, coalesce(cd.message, opening.message) AS root_cause,
    regexp_extract(coalesce(cd.message, opening.message), '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1) AS root_exception_class, detection_source
  FROM y JOIN z ON z.region = y.region LEFT JOIN q ON q.region = y.region LEFT JOIN ec ON ec.region = y.region LEFT JOIN cd ON cd.region = y.region AND place = 1""")
def incident_records(spark, sf_dir):
    regions = _regions(spark, sf_dir)
    members = incidents.in_regions(_events(spark, sf_dir), regions)
    scored = lineage.cut(incidents.candidate_scores(members))
    return incidents.incident_records(members, scored, lineage.cut(incidents.root_candidates(scored)), regions)


@_query(f"WITH {_MEMBERS} SELECT region, trace_id, count(*) AS n, count(*) FILTER (is_error) AS errors FROM m WHERE trace_id <> '' GROUP BY 1, 2")
def incident_traces(spark, sf_dir):
    return incidents.incident_traces(_members(spark, sf_dir))


@_query(f"""WITH {_CANDIDATES} SELECT (SELECT count(*) FROM f) AS events, (SELECT count(*) FROM f WHERE is_error) AS errors, (SELECT count(*) FROM f WHERE is_technical) AS technical_errors,
  (SELECT count(DISTINCT c) FROM (SELECT regexp_extract(message, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1) AS c FROM f) WHERE c <> '') AS classes, (SELECT count(DISTINCT region) FROM m) AS regions,
  (SELECT count(DISTINCT event_id) FROM m) AS assigned, (SELECT count(DISTINCT family) FROM cd WHERE place = 1) AS promoted""")
def run_summary(spark, sf_dir):
    return incidents.run_summary(_events(spark, sf_dir), *_first(spark, sf_dir))


@_query(f"""WITH {_MEMBERS}, e AS (SELECT event_id, regexp_extract(message, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1) AS class FROM f WHERE is_error)
  SELECT class, count(DISTINCT e.event_id) AS n, count(DISTINCT m.event_id) AS assigned, count(DISTINCT region) AS regions FROM e LEFT JOIN m ON m.event_id = e.event_id WHERE class <> '' GROUP BY class""")
def class_audit(spark, sf_dir):
    return incidents.class_audit(_events(spark, sf_dir), _members(spark, sf_dir))


@_query(f"WITH {_EV} SELECT row_number() OVER (ORDER BY event_s, event_id) AS place, event_id, event_s, level, service FROM ev WHERE trace_id = 'tr-7'")
def trace_lookup(spark, sf_dir):
    return incidents.trace_events(_events(spark, sf_dir), "tr-7")


# --- reports over orders: parts as roots, suppliers as chains ------------------------------------------------------------

_FACTS = """rt AS (SELECT l_orderkey AS id, 'p:' || l_partkey % 50 AS node, CASE l_partkey % 5 WHEN 0 THEN 'redis_timeout' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'connect' ELSE 'm' || l_partkey % 5 END AS mode, CAST(o_orderdate AS DATE) AS created
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1), ch AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE WHEN l_linenumber % 3 = 0 THEN 'p:' || l_partkey % 50 ELSE 's:' || l_suppkey % 40 END AS node, CAST(o_orderdate AS DATE) AS created
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 <> 0)"""


def _facts(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("created", F.col("o_orderdate").cast("date"))
    part, supplier = F.concat(F.lit("p:"), (F.col("l_partkey") % 50).cast("string")), F.concat(F.lit("s:"), (F.col("l_suppkey") % 40).cast("string"))
    fifth = F.col("l_partkey") % 5
    mode = F.when(fifth == 0, "redis_timeout").when(fifth == 1, "Timeout").when(fifth == 2, "connect").otherwise(F.concat(F.lit("m"), fifth.cast("string")))
    roots = both.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), part.alias("node"), mode.alias("mode"), "created")
    chains = both.filter("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") % 3 == 0, part).otherwise(supplier).alias("node"), "created")
    return roots, chains, roots.count()


_NODES = f"""{_FACTS}, hh AS (SELECT id, node, created, 1 AS root, 0 AS chain FROM rt UNION ALL SELECT DISTINCT id, node, created, 0, 1 FROM ch), tt AS (SELECT count(*) AS total FROM rt),
mo AS (SELECT node, mode, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, mode) AS r FROM rt GROUP BY node, mode), nr AS (SELECT hh.node, CAST(sum(root) AS BIGINT) AS root_hits, CAST(sum(chain) AS BIGINT) AS chain_hits, count(DISTINCT id) AS incidents,
round(sum(root) / any_value(total), 4) AS root_ratio, round(count(DISTINCT id) / any_value(total), 4) AS incident_ratio, coalesce((SELECT string_agg(mode, ',' ORDER BY r) FROM mo WHERE mo.node = hh.node AND r <= 3), '') AS modes, max(created) AS latest FROM hh, tt GROUP BY hh.node)"""


@_query(f"WITH {_NODES} SELECT * FROM nr")
def node_report(spark, sf_dir):
    return reports.node_report(*_facts(spark, sf_dir))


@_query(f"WITH {_NODES} SELECT *, row_number() OVER (ORDER BY root_hits DESC, incidents DESC, chain_hits DESC, lower(node), node) AS place FROM nr QUALIFY place <= 10")
def top_nodes(spark, sf_dir):
    return reports.top_nodes(reports.node_report(*_facts(spark, sf_dir)), 10)


@_query(f"""WITH {_FACTS}, tp AS (SELECT node FROM rt GROUP BY node ORDER BY count(*) DESC, node LIMIT 5), af AS (SELECT rt.node, ch.node AS affected, count(DISTINCT rt.id) AS n FROM rt JOIN tp ON tp.node = rt.node JOIN ch ON ch.id = rt.id WHERE ch.node <> rt.node GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, affected) AS place FROM af QUALIFY place <= 5""")
def affected_nodes(spark, sf_dir):
    roots, chains, _ = _facts(spark, sf_dir)
    return reports.affected_nodes(roots, chains)


@_query(f"""WITH {_FACTS}, la AS (SELECT *, CASE WHEN mode = 'redis_timeout' THEN 'Redis 访问超时' WHEN mode = 'Timeout' THEN '请求处理超时' WHEN mode = 'connect' THEN '连接异常' ELSE mode END AS label FROM rt), tn AS (SELECT label, node, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, node) AS r FROM la GROUP BY 1, 2)
  SELECT la.label, count(*) AS n, round(count(*) / (SELECT count(*) FROM rt), 4) AS ratio, string_agg(DISTINCT mode, ',' ORDER BY mode) AS raw_modes, (SELECT node FROM tn WHERE tn.label = la.label AND r = 1) AS top_root FROM la GROUP BY la.label""")
def mode_report(spark, sf_dir):
    roots, _, total = _facts(spark, sf_dir)
    return reports.mode_report(roots, text_rules.fault_label(F.col("mode")), total)


@_query(f"""WITH {_FACTS}, fi AS (SELECT id, node, min(place) AS place FROM ch GROUP BY 1, 2), pa AS (SELECT id, list(node ORDER BY place, node) AS path FROM fi GROUP BY id UNION ALL SELECT id, [node] FROM rt WHERE id NOT IN (SELECT id FROM ch))
  SELECT array_to_string(path, ' → ') AS path, any_value(len(path)) AS length, count(*) AS n, round(count(*) / (SELECT count(*) FROM rt), 4) AS ratio FROM pa GROUP BY 1""")
def path_report(spark, sf_dir):
    roots, chains, total = _facts(spark, sf_dir)
    return reports.path_report(chains, roots, total)


@_query(f"""WITH {_ORDERS} SELECT project, count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (severity = 'critical' AND status <> 'resolved') AS open_critical, round(count(*) FILTER (status = 'resolved') / count(*), 4) AS resolution,
  arg_max(id, struct_pack(a := created, b := id)) AS latest FROM inc GROUP BY project""")
def dashboard(spark, sf_dir):
    return reports.dashboard(_incidents(spark, sf_dir))


@_query("""WITH o AS (SELECT o_custkey AS batch, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS latest FROM orders GROUP BY 1), b AS (SELECT c_custkey AS batch, c_name AS name FROM customer WHERE c_custkey % 4 <> 0)
  SELECT coalesce(b.batch, o.batch) AS batch, coalesce(name, 'I' || lpad(CAST(o.batch AS VARCHAR), 5, '0')) AS name, coalesce(n, 0) AS n, latest FROM b FULL JOIN o ON b.batch = o.batch""")
def incident_batches(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderdate").cast("date").alias("created"))
    return reports.with_batches(rows, _table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("batch"), F.col("c_name").alias("name")))


@_query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'check logs' WHEN 1 THEN 'restart ' || o_orderpriority ELSE 'check logs' END AS step FROM orders UNION ALL SELECT o_orderkey, 'page ' || o_orderstatus FROM orders) SELECT step, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, step) AS place FROM s GROUP BY step""")
def step_frequency(spark, sf_dir):
    said = "'1. ' || CASE o_orderkey % 3 WHEN 0 THEN 'check logs' WHEN 1 THEN 'restart ' || o_orderpriority ELSE ' check logs ' END || '；- page ' || o_orderstatus || ';'"
    return reports.step_frequency(_table(spark, sf_dir, "orders").select(F.expr(said).alias("said")), text_rules.steps(F.col("said")))


# --- root causes: every error as an incident of its service; nations are redis clusters of suppliers, regions databases and queues ----

_LATE = "regexp_matches(t, 'timeout|timed out')"
_REDIS, _REFUSED = "regexp_matches(t, 'redis|lettuce|jedis')", "regexp_matches(t, 'connection refused|redisconnectionexception|cannot connect|connection reset|nic link down')"
_POOL, _STORE, _DEAD, _WAIT = "regexp_matches(t, 'hikaripool|hikari')", "regexp_matches(t, 'mysql|jdbc|sql')", "regexp_matches(t, 'deadlock|mysqltransactionrollbackexception')", "contains(t, 'lock wait timeout')"
_PLAIN = f"{_STORE} AND NOT {_DEAD} AND NOT {_WAIT} AND NOT {_POOL}"
_REDIS_KINDS, _DB_KINDS, _BOXES = "Cache Cluster Instance Host Database Middleware", "Database Cluster Instance Host", "Host Instance Pod VM"
# Mode, condition on the lowered text t, tokens, kinds, base, whether it is told by a timeout alone.
_MODES = (
    ("JVM_OOM", "regexp_matches(t, 'outofmemoryerror|java heap space|metaspace|gc overhead limit')", "", "Service Pod Instance", 0.44, "false"),
    ("REDIS_UNREACHABLE", f"{_REDIS} AND {_REFUSED}", "redis lettuce jedis", _REDIS_KINDS, 0.46, "false"),
    ("REDIS_TIMEOUT", f"{_REDIS} AND NOT {_REFUSED} AND regexp_matches(t, 'timeout|timed out|querytimeoutexception|rediscommandtimeoutexception')", "redis lettuce jedis", _REDIS_KINDS, 0.30, "true"),
    ("DB_POOL_EXHAUSTED", f"{_POOL} AND regexp_matches(t, 'connection is not available|sqltransientconnectionexception|timed out after')", "hikari hikaripool database mysql jdbc", "Database Service Cluster Host", 0.42, "true"),
    ("DB_DEADLOCK", f"{_STORE} AND {_DEAD}", "mysql database 数据库 jdbc", _DB_KINDS, 0.48, "false"),
    ("DB_LOCK_TIMEOUT", f"{_STORE} AND NOT {_DEAD} AND {_WAIT}", "mysql database 数据库 jdbc", _DB_KINDS, 0.44, "true"),
    ("DATABASE_UNREACHABLE", f"{_PLAIN} AND contains(t, 'connection refused')", "mysql database 数据库 jdbc hikari", _DB_KINDS, 0.38, _LATE),
    ("DATABASE_FAILURE", f"{_PLAIN} AND NOT contains(t, 'connection refused')", "mysql database 数据库 jdbc hikari", _DB_KINDS, 0.38, _LATE),
    ("MESSAGE_BROKER_FAILURE", "regexp_matches(t, 'kafka|rabbitmq|rocketmq|alreadyclosedexception|amqp')", "kafka rabbitmq rocketmq mq amqp", "Queue Cluster Instance Host Middleware", 0.40, _LATE),
    ("DISK_IO_FAILURE", "regexp_matches(t, 'read-only file system|readonly filesystem') OR contains(t, 'ioexception') AND regexp_matches(t, 'disk|file system|filesystem|/var/|physical-host')", "disk filesystem physical-host host", _BOXES, 0.46, "false"),
    ("CPU_OVERLOAD", "regexp_matches(t, 'cpu 100%|cpu load|thread contention') AND regexp_matches(t, 'physical-host|host|pod|node')", "cpu physical-host host load", _BOXES, 0.42, "true"),
    ("NETWORK_FAILURE", "regexp_matches(t, 'nic link down|network packet loss|hardware host crash') OR regexp_matches(t, 'physical-host|host') AND regexp_matches(t, 'connectexception|unreachable|disconnected|packet loss')", "physical-host host nic network", "Host Instance VM Cluster", 0.48, "false"),
    ("AUTH_FAILURE", "regexp_matches(t, ' 401 |unauthorized|invalid oauth|expired signature|invalid token|token expired')", "", "Service API Component", 0.40, "false"),
    ("CIRCUIT_BREAKER_OPEN", "regexp_matches(t, 'circuit breaker|circuitbreaker|hystrix|resilience4j') AND regexp_matches(t, 'open|tripped|short-circuit|fallback')", "", "Service API Component Middleware", 0.30, "false"),
)


def _signal(place: int, mode: str, holds: str, tokens: str, kinds: str, base: float, late: str) -> str:
    return f"{{place: {place}, mode: '{mode}', holds: {holds}, tokens: string_split('{tokens}', ' '), plain: {str(not tokens).lower()}, kinds: string_split('{kinds}', ' '), base: {base}::DOUBLE, late: {late}}}"


_ARCHITECTURE = """SELECT DISTINCT service AS name, 'Service' AS kind, '' AS host FROM {ev} UNION ALL SELECT 'redis-' || replace(lower(n_name), ' ', '-'), 'Cluster', '' FROM {nation}
  UNION ALL SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'mysql-' ELSE 'rabbitmq-' END || replace(lower(r_name), ' ', '-'), CASE WHEN r_regionkey % 2 = 0 THEN 'Database' ELSE 'Queue' END, '' FROM {region}
  UNION ALL SELECT 'redis-' || CAST(s_suppkey AS STRING), 'Instance', 'redis-' || CAST(s_suppkey AS STRING) FROM {supplier}"""
_DEPENDENCIES = """SELECT service AS source, 'redis-' || replace(lower(n_name), ' ', '-') AS target, 'DEPENDS_ON' AS type FROM (SELECT DISTINCT service FROM {ev}) JOIN {nation} ON 'svc-' || CAST(n_nationkey % 6 AS STRING) = service
  UNION ALL SELECT service, CASE WHEN r_regionkey % 2 = 0 THEN 'mysql-' ELSE 'rabbitmq-' END || replace(lower(r_name), ' ', '-'), 'DEPENDS_ON' FROM (SELECT DISTINCT service FROM {ev}) JOIN {region} ON 'svc-' || CAST(r_regionkey AS STRING) = service
  UNION ALL SELECT a.service, b.service, 'CALLS' FROM (SELECT DISTINCT service FROM {ev}) a JOIN (SELECT DISTINCT service FROM {ev}) b ON CAST(substr(a.service, 5) AS INT) + 1 = CAST(substr(b.service, 5) AS INT)
  UNION ALL SELECT 'redis-' || replace(lower(n_name), ' ', '-'), 'redis-' || CAST(s_suppkey AS STRING), 'HAS_MEMBER' FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey"""
_PLAIN_NAMES = {"ev": "ev", "nation": "nation", "region": "region", "supplier": "supplier"}
_RCA = rf"""WITH RECURSIVE {_EV}, nodes AS ({_ARCHITECTURE.format(**_PLAIN_NAMES).replace('STRING', 'VARCHAR')}), edges AS ({_DEPENDENCIES.format(**_PLAIN_NAMES).replace('STRING', 'VARCHAR')}),
every AS (SELECT 'I' || event_id AS incident, service, message, lower(message) AS t, 'svc-' || ((user_id + 5) % 6) AS caller FROM ev WHERE level IN ('ERROR', 'FATAL')),
inc AS (SELECT DISTINCT md5(service || '|' || caller || '|' || message) AS incident, service, message, t, caller FROM every),
shown AS (SELECT *, list_filter([{', '.join(_signal(i, *m) for i, m in enumerate(_MODES))}], lambda x: x.holds) AS found FROM inc),
sg AS (SELECT incident, unnest(CASE WHEN len(found) > 0 THEN found WHEN regexp_matches(t, 'timeout|timed out|connection refused|connection reset') THEN [{_signal(90, 'DEPENDENCY_FAILURE', 'true', '', 'Database Cache Queue Middleware Cluster Instance Host Service', 0.22, _LATE)}]
  ELSE [{_signal(91, 'APPLICATION_ERROR', 'true', '', 'Service API Component', 0.18, 'false')}] END, recursive := true) FROM shown),
en AS (SELECT DISTINCT incident, lower(e) AS endpoint FROM (SELECT incident, unnest(list_concat(list_concat(regexp_extract_all(message, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?::[0-9]{{2,5}})?\b'), list_filter(regexp_extract_all(message, '\b[a-zA-Z][a-zA-Z0-9_.-]{{1,80}}:[0-9]{{2,5}}\b'), lambda x: NOT regexp_full_match(lower(x), 'https?:[0-9]+'))),
    regexp_extract_all(message, '(?i)\b(?:host|hostname|node|instance|endpoint|server|redis)\s*[=:]\s*([a-z0-9_.-]+(?::[0-9]{{2,5}})?)', 1))) AS e FROM inc)),
ids AS (SELECT name, lower(name) AS id FROM nodes UNION SELECT name, host FROM nodes WHERE host <> '' UNION SELECT name, host || ':6379' FROM nodes WHERE host <> ''),
em AS (SELECT incident, name, min(endpoint) AS endpoint FROM en JOIN ids ON id = endpoint OR NOT contains(endpoint, ':') AND string_split(id, ':')[1] = endpoint GROUP BY ALL),
tx AS (SELECT name, kind, lower(name || ' ' || kind || '  ' || CASE WHEN host <> '' THEN '{{"host":"' || host || '","port":"6379"}}' ELSE '' END) AS own FROM nodes),
walk AS (SELECT name AS seed, name AS node, [name] AS path FROM nodes WHERE kind = 'Service' UNION ALL SELECT seed, target, list_append(path, target) FROM walk JOIN edges ON source = node WHERE len(path) < 6 AND NOT list_contains(path, target)),
pt AS (SELECT seed, node AS name, arg_min(path, struct_pack(a := len(path), b := path)) AS path FROM walk GROUP BY ALL),
near AS (SELECT incident, service AS anchor, name, path FROM inc JOIN pt ON seed = service),
ctx AS (SELECT seed, pt.name, string_agg(own, ' ') AS context FROM (SELECT seed, name, unnest(path) AS step FROM pt) pt JOIN tx ON tx.name = step GROUP BY ALL),
pr AS (SELECT sg.incident, sg.place, tx.name, true AS told FROM sg JOIN tx ON NOT plain AND len(list_filter(tokens, lambda k: contains(own, k))) > 0 UNION ALL SELECT sg.incident, place, name, false FROM sg JOIN near ON near.incident = sg.incident UNION ALL SELECT sg.incident, place, name, false FROM sg JOIN em ON em.incident = sg.incident),
pu AS (SELECT incident, place, name, bool_or(told) AS told FROM pr GROUP BY ALL),
pm AS (SELECT sg.*, pu.name, told, tx.kind, near.path, inc.service AS anchor, em.endpoint, list_contains(kinds, tx.kind) AS fits,
    len(list_filter(tokens, lambda k: contains(coalesce(context, ''), k))) > 0 AS on_way
  FROM pu JOIN sg ON sg.incident = pu.incident AND sg.place = pu.place JOIN inc ON inc.incident = pu.incident JOIN tx ON tx.name = pu.name LEFT JOIN near ON near.incident = pu.incident AND near.name = pu.name
  LEFT JOIN ctx ON ctx.seed = inc.service AND ctx.name = pu.name AND near.path IS NOT NULL LEFT JOIN em ON em.incident = pu.incident AND em.name = pu.name),
pf AS (SELECT *, CASE WHEN plain THEN CASE WHEN fits AND path IS NOT NULL THEN 1 ELSE 0 END WHEN told THEN 2 WHEN fits AND on_way THEN 1 ELSE 0 END AS match FROM pm),
ps AS (SELECT incident, name, kind, mode, place, path, endpoint, anchor, late, least(greatest(base + CASE match WHEN 2 THEN 0.16::DOUBLE WHEN 1 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN fits THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN path IS NOT NULL THEN greatest(0.05::DOUBLE, 0.18::DOUBLE - greatest(len(path) - 2, 0) * 0.025::DOUBLE) ELSE 0.0::DOUBLE END + CASE WHEN endpoint IS NOT NULL THEN 0.27::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN kind = 'Cluster' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN kind IN ('Instance', 'Host', 'Pod') AND endpoint IS NULL AND mode NOT IN ('JVM_OOM', 'DISK_IO_FAILURE', 'CPU_OVERLOAD', 'NETWORK_FAILURE', 'DB_POOL_EXHAUSTED') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN name = anchor AND path IS NOT NULL THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END, 0.05::DOUBLE), 0.98::DOUBLE) AS score FROM pf WHERE endpoint IS NOT NULL OR match > 0 AND NOT (kind = 'Service' AND match < 2)
  UNION ALL SELECT sg.incident, service, 'Service', mode, place - 100, [service], NULL, service, late, least(base + 0.34::DOUBLE, 0.90::DOUBLE) FROM sg JOIN inc ON inc.incident = sg.incident WHERE mode IN ('JVM_OOM', 'AUTH_FAILURE', 'CIRCUIT_BREAKER_OPEN')),
bs AS (SELECT incident, name, arg_max(ps, struct_pack(a := score, b := -place)) AS b, count(*) AS signals FROM ps GROUP BY ALL),
cd AS (SELECT incident, name, signals, b.kind, b.mode, b.path, b.endpoint, b.anchor, b.late, CASE WHEN signals > 1 THEN least(b.score + least((signals - 1) * 0.03::DOUBLE, 0.09::DOUBLE), 0.98::DOUBLE) ELSE b.score END AS score FROM bs),
lf AS (SELECT inc.incident, service, arg_min(sg, place) AS s, (SELECT min(endpoint) FROM en WHERE en.incident = inc.incident) AS spot FROM inc JOIN sg ON sg.incident = inc.incident WHERE inc.incident NOT IN (SELECT incident FROM cd) GROUP BY ALL),
al AS (SELECT * FROM cd UNION ALL SELECT incident, CASE WHEN lost THEN '未知组件@' || spot ELSE service END, 0, CASE WHEN lost THEN 'UnresolvedDependency' ELSE 'Service' END, s.mode, [service], NULL, service, s.late, CASE WHEN lost THEN least(s.base + 0.05::DOUBLE, 0.38::DOUBLE) ELSE least(s.base + 0.12::DOUBLE, 0.45::DOUBLE) END
  FROM (SELECT *, spot IS NOT NULL AND s.mode IN ('MESSAGE_BROKER_FAILURE', 'REDIS_UNREACHABLE', 'DATABASE_UNREACHABLE') AS lost FROM lf)),
rk AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, name) AS rank, round(score, 3) AS shown FROM al QUALIFY rank <= 5),
up AS (SELECT inc.incident, list_reverse(path) AS callers FROM inc JOIN pt ON seed = caller AND pt.name = service AND caller <> service AND len(path) <= 5),
mc AS (SELECT source AS name, count(DISTINCT target) AS n FROM edges WHERE type = 'HAS_MEMBER' GROUP BY source),
out AS (SELECT rk.*, callers, coalesce(list_reverse(path), [rk.name]) AS way, coalesce(mc.n, 0) AS members FROM rk LEFT JOIN up ON up.incident = rk.incident LEFT JOIN mc ON mc.name = rk.name)
SELECT every.incident, rank, out.name AS candidate, kind, mode, shown AS score, CASE WHEN shown >= 0.75 THEN 'probable' WHEN shown >= 0.5 THEN 'suspected' ELSE 'weak' END AS status,
  array_to_string(CASE WHEN way[len(way)] = callers[1] THEN list_concat(way, callers[2:]) ELSE way END, '>') AS chain,
  concat_ws(',', CASE WHEN path IS NULL AND out.name <> anchor THEN 'no_path' END, CASE WHEN late THEN 'timeout_only' END, CASE WHEN members > 0 AND out.incident NOT IN (SELECT incident FROM en) THEN 'member_unknown' END,
    CASE WHEN kind IN ('Instance', 'Host', 'Pod') AND endpoint IS NULL THEN 'no_endpoint' END, CASE WHEN signals = 0 THEN 'no_dependency' END) AS missing
FROM every JOIN out ON out.incident = md5(every.service || '|' || every.caller || '|' || every.message)"""


def _architecture(spark, sf_dir):
    """Nodes and dependencies of the services that the log names."""
    t = {n: _table(spark, sf_dir, n) for n in ("nation", "region", "supplier")} | {"ev": lineage.cut(_events(spark, sf_dir).select("service").distinct())}
    names = {n: "{" + n + "}" for n in t}
    meta = F.when(F.col("host") != "", F.create_map(F.lit("host"), F.col("host"), F.lit("port"), F.lit("6379")))
    nodes = spark.sql(_ARCHITECTURE.format(**names), **t).select("name", "kind", F.lit("").alias("description"), meta.alias("meta"))
    return nodes, spark.sql(_DEPENDENCIES.format(**names), **t)


@_query(_RCA)
def root_causes(spark, sf_dir):
    from ..operators import rca

    caller = F.concat(F.lit("svc-"), ((F.col("user_id") + 5) % 6).cast("string"))
    found = _events(spark, sf_dir).filter("level in ('ERROR', 'FATAL')").select(F.concat(F.lit("I"), F.col("event_id").cast("string")).alias("incident"), "service", F.col("message").alias("evidence"), F.array(caller).alias("callers"))
    return rca.hypotheses(found, *_architecture(spark, sf_dir)).withColumn("chain", F.array_join("chain", ">"))


# --- what a batch says in sentences ---------------------------------------------------------------------------------------

_BATCH = f"""{_NODES}, st AS (SELECT DISTINCT rt.id, o_orderstatus = 'F' AS resolved FROM rt JOIN orders ON o_orderkey = rt.id),
su AS (SELECT (SELECT count(*) FROM st) AS incidents, (SELECT count(*) FROM st WHERE resolved) AS resolved, (SELECT count(DISTINCT node) FROM rt) AS root_nodes, (SELECT count(DISTINCT node) FROM (SELECT node FROM rt UNION ALL SELECT node FROM ch)) AS nodes),
tp AS (SELECT * FROM nr WHERE root_hits > 0 ORDER BY root_hits DESC, incidents DESC, chain_hits DESC, lower(node), node LIMIT 1),
la AS (SELECT CASE mode WHEN 'redis_timeout' THEN 'Redis 访问超时' WHEN 'Timeout' THEN '请求处理超时' WHEN 'connect' THEN '连接异常' ELSE mode END AS label, node FROM rt),
md AS (SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM rt), 4) AS ratio FROM la GROUP BY label ORDER BY n DESC, label LIMIT 1),
mt AS (SELECT node FROM la WHERE label = (SELECT label FROM md) GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)"""


def _batch(spark, sf_dir):
    roots, chains, total = _facts(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status")
    found = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status).join(roots.select("id"), "id", "left_semi")
    modes = reports.mode_report(roots, text_rules.fault_label(F.col("mode")), total)
    return reports.batch_summary(found, roots, chains), reports.node_report(roots, chains, total), modes, (chains, roots, total)


@_query(f"""WITH {_BATCH}, fi AS (SELECT id, node, min(place) AS place FROM ch GROUP BY 1, 2), pa AS (SELECT id, string_agg(node, ' → ' ORDER BY place, node) AS path FROM fi GROUP BY id UNION ALL SELECT id, node FROM rt WHERE id NOT IN (SELECT id FROM ch)),
  wy AS (SELECT path, count(*) AS n FROM pa GROUP BY path ORDER BY n DESC, path LIMIT 1)
  SELECT 1 AS place, '本批次共形成 ' || incidents || ' 个 RCA 故障结论，涉及 ' || root_nodes || ' 个根因节点和 ' || nodes || ' 个传播节点。' AS text FROM su
  UNION ALL SELECT 2, '故障最集中于“' || node || '”：' || root_hits || ' 次被判定为根因，出现在 ' || incidents || ' 个故障和 ' || chain_hits || ' 条传播链中。' FROM tp
  UNION ALL SELECT 3, '最主要的故障模式是“' || label || '”，共 ' || n || ' 次，占本批次故障的 ' || CAST(round_even(100 * ratio, 0) AS BIGINT) || '%。' FROM md
  UNION ALL SELECT 4, '最高频传播路径为“' || path || '”，关联 ' || n || ' 个故障。' FROM wy
  UNION ALL SELECT 5, '当前已解决 ' || resolved || ' 个，仍有 ' || (incidents - resolved) || ' 个未完成闭环，批次治理完成率为 ' || CAST(round_even(100 * round(resolved / incidents, 4), 0) AS BIGINT) || '%。' FROM su""")
def batch_conclusions(spark, sf_dir):
    summary, nodes, modes, ways = _batch(spark, sf_dir)
    return reports.conclusions(summary, nodes, modes, reports.path_report(*ways))


@_query(f"""WITH {_BATCH}, sp AS (SELECT step, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 1 THEN 'restart ' || o_orderpriority ELSE 'check logs' END AS step FROM orders) GROUP BY step ORDER BY n DESC, step LIMIT 1)
  SELECT 1 AS place, CASE WHEN root_ratio >= 0.5 THEN 'P0' ELSE 'P1' END AS priority, '优先治理高频根因节点：' || node AS title, '该节点关联 ' || incidents || ' 个故障、' || root_hits || ' 次作为根因，应优先核查其健康状态、容量和高可用机制。' AS description, node, incidents AS n FROM tp
  UNION ALL SELECT 2, 'P1', '建立“' || label || '”专项检测与告警', '该模式出现 ' || n || ' 次，建议统一监控指标、告警阈值和标准处置手册。', (SELECT node FROM mt), n FROM md
  UNION ALL SELECT 3, 'P1', '完成未闭环故障的验证与复盘', '仍有 ' || (incidents - resolved) || ' 个故障未标记为已解决，应补充恢复验证、解决说明和复发防护措施。', '', incidents - resolved FROM su
  UNION ALL SELECT 4, 'P2', '固化批次共性排查动作', step, '', n FROM sp""")
def batch_recommendations(spark, sf_dir):
    summary, nodes, modes, _ = _batch(spark, sf_dir)
    said = F.expr("case o_orderkey % 3 when 1 then 'restart ' || o_orderpriority else 'check logs' end").alias("said")
    return reports.recommendations(summary, nodes, modes, reports.step_frequency(_table(spark, sf_dir, "orders").select(said), text_rules.steps(F.col("said"))))
