"""Queries of grounding with their DuckDB equivalents: names in log texts, grounded paths, members, scopes, encoded catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, checks, grounding, lineage
from .incident_queries import _ARCHITECTURE, _PLAIN_NAMES, _architecture
from .registry import _EV, _GRAPH, _events, _query, static_graph

_NODES = f"{_EV}, nodes AS ({_ARCHITECTURE.format(**_PLAIN_NAMES).replace('STRING', 'VARCHAR')})"


@_query(f"""WITH {_NODES}, ids AS (SELECT name, name AS word, 0 AS place FROM nodes UNION ALL SELECT name, host, 1 FROM nodes WHERE host <> '' UNION ALL SELECT name, host || ':6379', 2 FROM nodes WHERE host <> ''),
  said AS (SELECT DISTINCT message FROM ev), found AS (SELECT message, name AS id, arg_min(word, place) AS identifier FROM said JOIN ids ON length(word) >= 3 AND strpos(lower(message), lower(word)) > 0 GROUP BY ALL)
  SELECT event_id AS incident, id, identifier FROM ev JOIN found ON found.message = ev.message""")
def node_mentions(spark, sf_dir):
    nodes, _ = _architecture(spark, sf_dir)
    host = F.try_element_at("meta", F.lit("host"))
    runtime = F.when(host.isNotNull(), F.create_map(F.lit("hostnames"), F.array(host), F.lit("endpoints"), F.array(F.concat(host, F.lit(":6379")))))
    nodes = nodes.select(F.col("name").alias("id"), "name", "kind", runtime.alias("runtime"))
    return grounding.identifier_matches(_events(spark, sf_dir).select(F.col("event_id").alias("incident"), F.col("message").alias("text")), nodes)


def _tree(spark, sf_dir):
    """The static graph without calls: regions over nations over suppliers, and customers that nothing is joined to."""
    nodes, edges = static_graph(spark, sf_dir)
    return lineage.cut(nodes), lineage.cut(edges.filter("type <> 'CALLS'"))


_STEPS = """sup AS (SELECT s_suppkey AS k, 's:' || s_suppkey AS s, s_name, 'n:' || n_nationkey AS n, n_name, 'r:' || r_regionkey AS r, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@_query(f"""WITH {_STEPS}, nx AS (SELECT a.*, b.s AS s2, b.s_name AS s2_name, b.n AS n2, b.n_name AS n2_name, b.r = a.r AS joined FROM sup a LEFT JOIN sup b ON b.k = a.k + 1), c AS (SELECT c_name FROM customer WHERE c_custkey = 1),
  w AS (SELECT s AS decision, CASE WHEN joined THEN [s, n, r, n2, s2] ELSE [s, n, r] END AS path, list_concat(list_concat(['忽略不存在的架构节点：invented'], CASE WHEN s2 IS NULL THEN ['忽略不存在的架构节点：s:' || (k + 1)] ELSE [] END),
    list_concat(list_concat(['大模型路径跳过了架构中间节点，系统已按真实拓扑补全'], CASE WHEN s2 IS NOT NULL AND NOT joined THEN ['架构图中不存在 ' || r_name || ' 到 ' || s2_name || ' 的连通路径'] ELSE [] END), ['架构图中不存在 ' || CASE WHEN joined THEN s2_name ELSE r_name END || ' 到 ' || c_name || ' 的连通路径'])) AS warnings FROM nx, c)
  SELECT decision, array_to_string(path, '>') AS path, array_to_string(list_transform(range(len(path)), lambda i: CASE WHEN i = 0 THEN '根因' WHEN i = len(path) - 1 THEN '受影响入口' ELSE '故障传播' END), '>') AS stages, array_to_string(warnings, '|') AS warnings FROM w""")
def grounded_paths(spark, sf_dir):
    """For each supplier a conclusion that names it, its region, nothing that exists, the next supplier, and a customer that no edge joins."""
    nodes, edges = _tree(spark, sf_dir)
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"))
    later = F.concat(F.lit("s:"), (F.col("s_suppkey") + 1).cast("string"))
    proposed = named.select(own.alias("decision"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(own).alias("selected"), F.array(own, F.lower("r_name"), F.lit("invented"), later, F.lit("c:1")).alias("steps"))
    found = grounding.grounded_paths(proposed, nodes, edges)
    joined = lambda f: F.array_join(F.transform("path", f), ">")
    return found.select("decision", joined(lambda x: x["node"]).alias("path"), joined(lambda x: x["stage"]).alias("stages"), F.array_join("warnings", "|").alias("warnings"))


# --- members: suppliers in three relations to nations, some of them no machines, some of these without an address ----------

_HELD = """nd AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'Middleware' ELSE 'System' END AS kind, false AS addressed FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Cluster', false FROM nation
  UNION ALL SELECT 's:' || s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'Component' ELSE 'Instance' END, s_suppkey % 2 = 0 FROM supplier),
mb AS (SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS member, 'CONTAINS' AS type FROM nation UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'BELONGS_TO' WHEN 1 THEN 'HAS_MEMBER' ELSE 'CONTAINS' END FROM supplier),
st AS (SELECT parent, member, c.kind, c.kind = 'Instance' OR c.addressed AND c.kind <> 'Cluster' AS concrete FROM mb JOIN nd p ON p.id = parent JOIN nd c ON c.id = member WHERE NOT (type = 'CONTAINS' AND p.kind = 'System')),
pm AS (SELECT parent AS id, member, [parent, member] AS path FROM st WHERE concrete AND parent LIKE 'n:%' UNION ALL SELECT a.parent, b.member, [a.parent, a.member, b.member] FROM st a JOIN st b ON b.parent = a.member AND b.concrete WHERE a.parent LIKE 'r:%')"""


def _held(spark, sf_dir):
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    none = F.lit(None).cast("map<string,array<string>>")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    runtime = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("ips"), F.array(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")))))
    nodes = region.select(key("r:", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "Middleware").otherwise("System").alias("kind"), none.alias("runtime"))
    nodes = nodes.unionByName(nation.select(key("n:", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Cluster").alias("kind"), none.alias("runtime")))
    nodes = nodes.unionByName(supplier.select(key("s:", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "Component").otherwise("Instance").alias("kind"), runtime.alias("runtime")))
    third, own, above = F.col("s_suppkey") % 3, key("s:", "s_suppkey"), key("n:", "s_nationkey")
    belongs = supplier.select(F.when(third == 0, own).otherwise(above).alias("source"), F.when(third == 0, above).otherwise(own).alias("target"), F.when(third == 0, "BELONGS_TO").when(third == 1, "HAS_MEMBER").otherwise("CONTAINS").alias("type"))
    return lineage.cut(nodes), lineage.cut(nation.select(key("r:", "n_regionkey").alias("source"), key("n:", "n_nationkey").alias("target"), F.lit("CONTAINS").alias("type")).unionByName(belongs))


@_query(f"WITH {_HELD} SELECT id, member, array_to_string(path, '>') AS path FROM pm")
def possible_members(spark, sf_dir):
    nodes, edges = _held(spark, sf_dir)
    return grounding.possible_members(nodes.filter("kind <> 'Instance'").select("id"), nodes, edges).select("id", "member", F.array_join("path", ">").alias("path"))


_MATCHED = "ma AS (SELECT 'n:' || s_nationkey AS selected, 's:' || s_suppkey AS member, s_name AS identifier FROM supplier WHERE s_suppkey % 4 = 0)"


def _matches(spark, sf_dir, incident):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 4 = 0")
    return supplier.select(incident.alias("incident"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("identifier"))


@_query(f"""WITH {_HELD}, {_MATCHED} SELECT pm.id AS incident, pm.id AS selected, row_number() OVER (PARTITION BY pm.id ORDER BY identifier IS NULL, lower(name), pm.member) AS place, pm.member, name,
  CASE WHEN identifier IS NULL THEN 'needs_investigation' ELSE 'priority_check' END AS status, coalesce(identifier, '') AS identifier FROM pm JOIN nd ON nd.id = pm.member LEFT JOIN ma ON ma.selected = pm.id AND ma.member = pm.member WHERE pm.id LIKE 'n:%'""")
def evident_members(spark, sf_dir):
    nodes, edges = _held(spark, sf_dir)
    decisions = nodes.filter("kind = 'Cluster'").select(F.col("id").alias("incident"), F.col("id").alias("selected"))
    return grounding.evident_members(decisions, nodes, edges, _matches(spark, sf_dir, F.concat(F.lit("n:"), F.col("s_nationkey").cast("string"))))


@_query(f"""WITH {_HELD}, n AS (SELECT id, count(*) AS n FROM pm GROUP BY id), j AS (SELECT 's:' || s_suppkey AS s, 'n:' || s_nationkey AS n, s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0 AND NOT coalesce(n.n = 1 AND pm.member IS NOT NULL, false) AS moved
    FROM supplier LEFT JOIN n ON n.id = 'n:' || s_nationkey LEFT JOIN pm ON pm.id = 'n:' || s_nationkey AND pm.member = 's:' || s_suppkey)
  SELECT s AS incident, CASE WHEN moved THEN n ELSE s END AS selected, CASE WHEN moved THEN s ELSE '' END AS demoted FROM j""")
def cluster_scope(spark, sf_dir):
    """Suppliers as conclusions: of every seventh no candidate names its nation."""
    nodes, edges = _held(spark, sf_dir)
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    own = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    candidates = F.array(F.lit("nobody"), F.when(F.col("s_suppkey") % 7 == 0, "nobody").otherwise(F.lower("n_name")), F.lit("r:0"))
    decisions = named.select(own.alias("incident"), own.alias("selected"), candidates.alias("candidates"))
    return grounding.cluster_scope(decisions, nodes, edges, _matches(spark, sf_dir, own))


# --- checks: of every supplier one that its address fits, one with another's, one that names nothing, one that lacks a port ---

_IP = "'10.0.' || CAST(s_nationkey AS STRING) || '.' || CAST(s_suppkey % 250 AS STRING)"
_CHECKS = f"""SELECT 's:' || CAST(s_suppkey AS STRING) AS decision, p AS place, CASE WHEN p = 3 THEN 'no-' || CAST(s_suppkey AS STRING) WHEN p = 2 THEN lower(s_name) ELSE 's:' || CAST(s_suppkey AS STRING) END AS node, CASE WHEN p = 5 THEN ' ' ELSE 'check ' || CAST(p AS STRING) END AS action,
  CASE p WHEN 1 THEN 'redis-cli -h [ip] -p [port] INFO' WHEN 2 THEN 'ping 10.9.9.9' WHEN 4 THEN 'curl --host=' || {_IP} || ' --port=99' WHEN 6 THEN 'ssh -h elsewhere' ELSE '' END AS template, CASE WHEN p = 1 THEN 'ok' ELSE '' END AS expected FROM {{s}} CROSS JOIN {{p}}"""


@_query(f"""WITH c AS ({_CHECKS.format(s='supplier', p='(SELECT unnest(range(1, 10)) AS p)').replace('STRING', 'VARCHAR')}), n AS (SELECT 's:' || s_suppkey AS id, s_name AS name, lower(s_name) AS low, {_IP.replace('STRING', 'VARCHAR')} AS ip, CASE WHEN s_suppkey % 3 = 0 THEN '6379' END AS port FROM supplier),
  j AS (SELECT c.*, n.*, CASE WHEN port IS NULL THEN ip ELSE ip || ':' || port END AS target FROM c LEFT JOIN n ON c.node = n.id OR c.node = low WHERE place <= 8 AND (n.id IS NULL OR trim(action) <> '')),
  f AS (SELECT *, CASE WHEN id IS NULL THEN '忽略未绑定到真实架构节点的排查步骤：' || node WHEN place = 2 THEN '排查命令包含未登记 IP 10.9.9.9，已隐藏参考命令' WHEN place = 4 THEN '排查命令包含未登记端口 99，已隐藏参考命令' WHEN place = 6 THEN '排查命令包含未登记主机 elsewhere，已隐藏参考命令' ELSE '' END AS warning,
    CASE WHEN place = 1 THEN 'redis-cli -h ' || ip || ' -p ' || coalesce(port, '') || ' INFO' ELSE '' END AS command FROM j)
  SELECT decision, place, id AS node, CASE WHEN id IS NULL THEN '' ELSE action || '；目标：' || name || '（' || target || '）' || CASE WHEN command <> '' THEN '；参考命令：' || command ELSE '' END || CASE WHEN expected <> '' THEN '；预期：' || expected ELSE '' END END AS display, command, warning FROM f""")
def bound_checks(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    proposed = spark.sql(_CHECKS.format(s="{s}", p="{p}"), s=supplier, p=spark.range(1, 10).select(F.col("id").alias("p"))).withColumns({"fields": F.array().cast("array<string>"), "template": F.translate("template", "[]", "{}")})
    runtime = F.create_map(F.lit("ips"), F.array(F.expr(_IP)), F.lit("ports"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("6379"))).otherwise(F.array().cast("array<string>")))
    return checks.bound_checks(proposed, supplier.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), runtime.alias("runtime")))


@_query("""WITH h AS (SELECT l_orderkey AS incident, l_linenumber AS rank, 'P' || l_partkey % 20 AS candidate FROM lineitem), d AS (SELECT o_orderkey AS decision, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' p' || o_custkey % 20 || ' ' END AS candidate, o_orderkey % 4 AS place FROM orders)
  SELECT decision, coalesce((SELECT min(rank) FROM h WHERE incident = decision AND trim(d.candidate) <> '' AND lower(h.candidate) = trim(d.candidate)), (SELECT min(rank) FROM h WHERE incident = decision AND rank = place)) AS rank FROM d""")
def chosen_hypotheses(spark, sf_dir):
    """Of each order's lines as hypotheses the one that a decision names, else the one of its rank."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    hypotheses = lines.select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("P"), (F.col("l_partkey") % 20).cast("string")).alias("candidate"))
    named = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" p"), (F.col("o_custkey") % 20).cast("string"), F.lit(" ")))
    decisions = orders.select(F.col("o_orderkey").alias("decision"), F.col("o_orderkey").alias("incident"), named.alias("candidate"), (F.col("o_orderkey") % 4).alias("place"))
    return checks.chosen_hypotheses(decisions, hypotheses)


@_query(f"""WITH {_GRAPH}, pn AS (SELECT id AS name, kind FROM nodes WHERE kind = 'Instance' UNION ALL SELECT 'I' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'Incident' ELSE 'Trace' END FROM region), kn AS (SELECT id AS name FROM nodes WHERE kind = 'Cluster' AND id <> 'n:3'),
  al AS (SELECT name FROM pn UNION SELECT name FROM kn), pe AS (SELECT * FROM edges WHERE type <> 'CALLS' UNION ALL SELECT id, id, 'SELF' FROM nodes WHERE kind = 'Instance'), ve AS (SELECT * FROM pe WHERE source <> target AND source IN (SELECT name FROM al) AND target IN (SELECT name FROM al))
  SELECT 'node' AS item, name AS a, kind AS b, '' AS c FROM pn WHERE kind = 'Incident' OR name IN (SELECT source FROM ve UNION SELECT target FROM ve) UNION ALL SELECT 'edge', source, target, type FROM ve""")
def pruned_pending(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    machines = nodes.filter("kind = 'Instance'")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    own = region.select(F.concat(F.lit("I"), F.col("r_regionkey").cast("string")).alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "Incident").otherwise("Trace").alias("kind"))
    loops = machines.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("SELF").alias("type"))
    kept, valid = checks.pruned_pending(machines.select(F.col("id").alias("name"), "kind").unionByName(own), edges.unionByName(loops), nodes.filter("kind = 'Cluster' and id <> 'n:3'").select(F.col("id").alias("name")))
    kept = kept.select(F.lit("node").alias("item"), F.col("name").alias("a"), F.col("kind").alias("b"), F.lit("").alias("c"))
    return kept.unionByName(valid.select(F.lit("edge").alias("item"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


# --- catalogs ------------------------------------------------------------------------------------------------------------

_KINDS = "CASE kind WHEN 'System' THEN 'SYS' WHEN 'Cluster' THEN 'CL' WHEN 'Instance' THEN 'IN' WHEN 'Service' THEN 'SV' END"
_TYPES = "CASE type WHEN 'CONTAINS' THEN 'N' WHEN 'HAS_MEMBER' THEN 'M' WHEN 'CALLS' THEN 'C' WHEN 'NEAR BY' THEN 'NEAR_BY' END"
_CODED = f"""{_GRAPH}, ae AS (SELECT * FROM edges UNION ALL SELECT source, target, 'NEAR BY' FROM edges WHERE type = 'CONTAINS'), rw AS (SELECT 'n' AS part, to_json([id, name, {_KINDS}]) AS item FROM nodes UNION ALL SELECT 'e', to_json([source, target, {_TYPES}]) FROM ae)"""


def _named(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    edges = lineage.cut(edges)
    return nodes, edges.unionByName(edges.filter("type = 'CONTAINS'").withColumn("type", F.lit("NEAR BY")))


@_query(f"""WITH {_CODED} SELECT part, item FROM rw UNION ALL SELECT DISTINCT 't', to_json([{_KINDS}, kind]) FROM nodes UNION ALL SELECT DISTINCT 'r', to_json([{_TYPES}, type]) FROM ae""")
def encoded_catalog(spark, sf_dir):
    return catalog.encoded(*_named(spark, sf_dir))


@_query(f"WITH {_GRAPH} SELECT 'node' AS item, id AS a, name AS b, kind AS c FROM nodes UNION ALL SELECT 'edge', source, target, type FROM edges UNION ALL SELECT 'edge', source, target, 'NEAR BY' FROM edges WHERE type = 'CONTAINS'")
def decoded_catalog(spark, sf_dir):
    nodes, edges = catalog.decoded(lineage.cut(catalog.encoded(*_named(spark, sf_dir))))
    nodes = nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("kind").alias("c"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("item"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


@_query(f"""WITH {_CODED}, h AS (SELECT sha256(part || item) AS h FROM rw), s AS (SELECT count(*) AS n, {', '.join(f"sum(CAST(CAST('0x' || substr(h, {i * 15 + 1}, 15) AS BIGINT) AS HUGEINT)) AS s{i}" for i in range(4))} FROM h)
  SELECT 'sha256:' || substr(sha256(n || ':' || {" || ':' || ".join(f"s{i}" for i in range(4))}), 1, 16) AS fingerprint FROM s""")
def catalog_fingerprint(spark, sf_dir):
    return catalog.fingerprint(*_named(spark, sf_dir))
