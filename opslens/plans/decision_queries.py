"""Queries of what is kept of decisions with their DuckDB equivalents, over incidents made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from .registry import _query, _table


def _some(spark, sf_dir, table: str, **columns: str):
    """The table's rows with the named expressions, in SQL that both engines take."""
    return _table(spark, sf_dir, table).select(*(F.expr(x.replace("VARCHAR", "STRING")).alias(n) for n, x in columns.items()))


_SHOWN = "CASE l_linenumber % 4 WHEN 0 THEN 'db' WHEN 1 THEN ' gw ' WHEN 2 THEN 'off' ELSE ' ' END"


@_query(f"""WITH c AS (SELECT o_orderkey AS decision, CASE WHEN o_orderkey % 3 = 0 THEN ['svc' || o_custkey, 'db', 'gw'] WHEN o_orderkey % 3 = 1 THEN ['db'] ELSE ['gw', 'mid', 'db', 'end'] END AS chain FROM orders),
  n AS (SELECT decision, len(chain) AS n, generate_subscripts(chain, 1) - 1 AS place, unnest(chain) AS node FROM c),
  l AS (SELECT l_orderkey AS decision, trim({_SHOWN}) AS node, max(struct_pack(place := l_linenumber, label := CASE WHEN l_linenumber = 4 THEN trim({_SHOWN}) ELSE l_returnflag || l_linenumber END, explanation := l_returnflag, stage := CASE WHEN l_linenumber = 5 THEN '' ELSE l_linestatus END)) AS x FROM lineitem GROUP BY 1, 2)
  SELECT n.decision, CAST(place AS INT) AS place, n.node, coalesce(x.label, n.node) AS label, coalesce(x.explanation, '') AS explanation, coalesce(nullif(x.stage, ''), CASE WHEN place = 0 THEN '根因' WHEN place = n - 1 THEN '受影响入口' ELSE '故障传播' END) AS stage
  FROM n LEFT JOIN l ON l.decision = n.decision AND l.node = n.node""")
def display_chains(spark, sf_dir):
    chains = _some(spark, sf_dir, "orders", decision="o_orderkey", chain="CASE WHEN o_orderkey % 3 = 0 THEN array(' svc' || o_custkey, 'db', ' ', 'gw') WHEN o_orderkey % 3 = 1 THEN array('db') ELSE array('gw', 'mid', 'db', 'end') END")
    labels = _some(spark, sf_dir, "lineitem", decision="l_orderkey", place="l_linenumber", node=_SHOWN, label="CASE WHEN l_linenumber = 4 THEN ' ' ELSE l_returnflag || l_linenumber END", explanation="l_returnflag", stage="CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linestatus END")
    return decisions.display_chains(chains, labels)


@_query("""WITH h AS (SELECT l_orderkey AS incident, arg_min(struct_pack(candidate := 'n' || l_suppkey, mode := l_returnflag || l_linenumber, confidence := CAST(l_discount AS DOUBLE) * 10, path := 'n' || l_suppkey || '>x'), struct_pack(a := l_linenumber, b := 'n' || l_suppkey, c := l_returnflag || l_linenumber, d := l_discount)) AS top FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
  o AS (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AS decided, CASE WHEN o_orderkey % 5 = 0 THEN '未知服务' ELSE 'svc-' || o_custkey % 9 END AS service, CASE WHEN o_orderkey % 4 = 0 THEN '未提取到明确异常' ELSE o_orderpriority END AS cause FROM orders),
  r AS (SELECT o.*, top, CASE WHEN decided AND o_orderkey % 2 = 1 THEN coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN 0.8::DOUBLE END, top.confidence, 0.0) ELSE coalesce(top.confidence, 0.0) END AS confidence FROM o LEFT JOIN h ON h.incident = o_orderkey)
  SELECT o_orderkey AS incident, service || '：' || cause AS title, CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN decided THEN 'c' || o_custkey ELSE coalesce(top.candidate, service) END AS candidate,
    round(confidence, 6) AS confidence, CASE WHEN decided THEN 'M' ELSE coalesce(top.mode, '') END AS mode, CASE WHEN decided THEN 'd>e' ELSE coalesce(top.path, '') END AS chain, decided FROM r""")
def promoted_incidents(spark, sf_dir):
    found = _some(spark, sf_dir, "orders", incident="o_orderkey", service="CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'svc-' || o_custkey % 9 END", cause="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END")
    guessed = _some(spark, sf_dir, "lineitem", incident="l_orderkey", rank="l_linenumber", candidate="'n' || l_suppkey", mode="l_returnflag || l_linenumber", score="CAST(l_discount AS DOUBLE) * 10", chain="array('n' || l_suppkey, 'x')").filter("rank > 1")
    made = _some(spark, sf_dir, "orders", incident="o_orderkey", node="CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE ' ' END", candidate="'c' || o_custkey", mode="'M'", confidence="CASE WHEN o_orderkey % 9 <> 0 THEN CAST(0.8 AS DOUBLE) END", path="CASE WHEN o_orderkey % 6 = 0 THEN array(' ') ELSE array('d ', 'e') END")
    rows = decisions.promoted(found, guessed, made)
    return rows.withColumns({"chain": F.array_join("chain", ">"), "confidence": F.round("confidence", 6)})


@_query("""WITH r AS (SELECT l_suppkey AS incident, l_orderkey * 10 + l_linenumber AS rank, 'n' || l_partkey AS candidate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, 'n' || l_partkey) AS pos FROM lineitem)
  SELECT incident, string_agg(rank || '=' || candidate, ',' ORDER BY pos) AS hypotheses, count(*) AS n FROM r WHERE pos <= 8 GROUP BY incident""")
def compacted_hypotheses(spark, sf_dir):
    rows = _some(spark, sf_dir, "lineitem", incident="l_suppkey", rank="l_orderkey * 10 + l_linenumber", candidate="'n' || l_partkey", note="l_returnflag")
    said = F.transform("hypotheses", lambda h: F.concat_ws("=", h["rank"].cast("string"), h["candidate"]))
    return decisions.compacted(rows).select("incident", F.array_join(said, ",").alias("hypotheses"), F.size("hypotheses").cast("long").alias("n"))


@_query("""WITH a AS (SELECT DISTINCT l_orderkey AS incident, 's:' || l_suppkey AS id, 'n:' || s_nationkey AS near FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), e AS (SELECT incident, id FROM a UNION SELECT incident, near FROM a),
  d AS (SELECT 's:' || s_suppkey AS id, 'of ' || s_name AS description FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation)
  SELECT incident, CAST(row_number() OVER (PARTITION BY incident ORDER BY e.id) AS INT) AS place, e.id, description FROM e JOIN d ON d.id = e.id QUALIFY place <= 40""")
def focus_descriptions(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = lines.select(F.col("l_orderkey").alias("incident"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name")).otherwise(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string"))).alias("name"))
    suppliers = _some(spark, sf_dir, "supplier", id="'s:' || s_suppkey", name="s_name", description="CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'of ' || s_name END")
    nodes = suppliers.unionByName(_some(spark, sf_dir, "nation", id="'n:' || n_nationkey", name="n_name", description="n_name"))
    return decisions.focus(named, nodes, _some(spark, sf_dir, "supplier", source="'n:' || s_nationkey", target="'s:' || s_suppkey", type="'HAS_MEMBER'"))


_SCOPED = "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'p' || c_custkey % 4 END"


@_query(f"""WITH n AS (SELECT 'c:' || c_custkey AS id, 'Service' AS kind, {_SCOPED} AS project FROM customer UNION ALL SELECT 'o:' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Incident' ELSE 'Component' END, 'p' || o_custkey % 4 FROM orders),
  e AS (SELECT 'o:' || o_orderkey AS source, 'c:' || o_custkey AS target FROM orders UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem),
  k AS (SELECT CASE WHEN s.project = t.project THEN s.project ELSE '' END AS project, s.id IS NULL OR t.id IS NULL AS invalid FROM e LEFT JOIN n s ON s.id = source LEFT JOIN n t ON t.id = target),
  p AS (SELECT 'p' || r_regionkey AS project FROM region)
  SELECT project, (SELECT count(*) FROM n WHERE n.project = p.project) AS nodes, (SELECT count(*) FROM k WHERE k.project = p.project) AS edges, (SELECT count(*) FROM n WHERE n.project = p.project AND kind <> 'Incident') AS architecture_nodes,
    (SELECT count(*) FROM n WHERE n.project = p.project AND kind = 'Incident') AS dynamic_nodes, 0 AS unscoped_nodes, (SELECT count(*) FROM k WHERE k.project = p.project AND invalid) AS invalid_edges FROM p
  UNION ALL SELECT NULL, (SELECT count(*) FROM n), (SELECT count(*) FROM k), (SELECT count(*) FROM n WHERE kind <> 'Incident'), (SELECT count(*) FROM n WHERE kind = 'Incident'), (SELECT count(*) FROM n WHERE project = ''), (SELECT count(*) FROM k WHERE invalid)""")
def project_overview(spark, sf_dir):
    orders = _some(spark, sf_dir, "orders", id="'o:' || o_orderkey", kind="CASE WHEN o_orderkey % 3 = 0 THEN 'Incident' ELSE 'Component' END", project="'p' || o_custkey % 4")
    nodes = _some(spark, sf_dir, "customer", id="'c:' || c_custkey", kind="'Service'", project=_SCOPED).unionByName(orders)
    edges = _some(spark, sf_dir, "orders", source="'o:' || o_orderkey", target="'c:' || o_custkey").unionByName(_some(spark, sf_dir, "lineitem", source="'o:' || l_orderkey", target="'s:' || l_suppkey"))
    return decisions.project_overview(nodes, edges, _some(spark, sf_dir, "region", project="'p' || r_regionkey"))
