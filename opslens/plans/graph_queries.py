"""Queries of graph edits and checks with their DuckDB equivalents.

The graph is the static one of registry.py with projects and sources, and nodes that analyses made of some events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, graph_edits, lineage
from .registry import _GRAPH, _query, _table, static_graph

_FIELDS = """CASE kind WHEN 'Service' THEN 'p1' WHEN 'Instance' THEN '' ELSE 'p0' END AS project, CASE kind WHEN 'System' THEN 'manual' WHEN 'Cluster' THEN 'arch.md' ELSE '' END AS source_file, id LIKE 's:%9' AS observed"""
_MADE = """SELECT 'x:' || CAST(event_id AS STRING) AS id, 'inc:b' || CAST(event_id % 3 AS STRING) || ':' || CAST(event_id AS STRING) AS name,
  CASE WHEN event_id % 100 = 0 THEN 'Incident' WHEN event_id % 100 = 20 THEN 'Trace' ELSE 'Exception' END AS kind, 'p' || CAST(event_id % 4 AS STRING) AS project, 'log' AS source_file, FALSE AS observed FROM {0} WHERE event_id % 20 = 0"""
_LINKED = """SELECT 'x:' || CAST(event_id AS STRING) AS source, CASE WHEN event_id % 40 = 0 THEN 's:' || CAST(event_id % 7 AS STRING) ELSE 'x:' || CAST(event_id - event_id % 100 AS STRING) END AS target, 'AFFECTS' AS type FROM {0} WHERE event_id % 20 = 0 AND event_id % 60 <> 20"""
_G = f"""{_GRAPH}, n0 AS (SELECT id, name, kind, {_FIELDS} FROM nodes UNION ALL {_MADE.format('events').replace('STRING', 'VARCHAR')}),
e0 AS (SELECT * FROM edges UNION ALL {_LINKED.format('events').replace('STRING', 'VARCHAR')})"""
_DYN = "('Incident', 'Trace', 'LogEvent', 'Exception', 'Window', 'Metric', 'RCAHypothesis', 'UnresolvedDependency')"
_BOTH = "source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)"


def _graph(spark, sf_dir):
    nodes, edges = static_graph(spark, sf_dir)
    nodes = nodes.selectExpr("id", "name", "kind", *(x.strip() for x in _FIELDS.split(", CASE")[:1]), "CASE" + _FIELDS.split(", CASE")[1].rsplit(", id", 1)[0], "id LIKE 's:%9' AS observed")
    events = _table(spark, sf_dir, "events")
    return nodes.unionByName(spark.sql(_MADE.format("{e}"), e=events)), edges.unionByName(spark.sql(_LINKED.format("{e}"), e=events))


def _cut_graph(spark, sf_dir):
    """The graph, checkpointed, for queries that read a side of it more than once."""
    return tuple(map(lineage.cut, _graph(spark, sf_dir)))


def _halves(nodes, edges):
    """Both sides of a graph as rows (item, a, b, c)."""
    nodes = nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("kind").alias("c"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("item"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


_N, _E = "SELECT 'node' AS item, id AS a, name AS b, kind AS c", "SELECT 'edge' AS item, source AS a, target AS b, type AS c"


def _rows(df, *extra):
    return df.select("source", "target", "type", *extra)


@_query(f"WITH {_G}, k AS (SELECT id FROM n0 WHERE kind NOT IN {_DYN} AND NOT observed) {_N} FROM n0 WHERE id IN (SELECT id FROM k) UNION ALL {_E} FROM e0 WHERE {_BOTH}")
def static_part(spark, sf_dir):
    return _halves(*graph_edits.static_part(*_cut_graph(spark, sf_dir)))


@_query(f"WITH {_G}, k AS (SELECT id FROM n0 WHERE project = 'p0' OR name LIKE 'project::p0::%') {_N} FROM n0 WHERE id IN (SELECT id FROM k) UNION ALL {_E} FROM e0 WHERE {_BOTH}")
def project_part(spark, sf_dir):
    return _halves(*graph_edits.project_part(*_cut_graph(spark, sf_dir), "p0"))


@_query(f"""WITH {_G} SELECT e.source, e.target, e.type FROM e0 e LEFT JOIN n0 s ON s.id = source LEFT JOIN n0 t ON t.id = target WHERE type IN ('CALLS', 'DEPENDS_ON', 'USES_DB', 'READS', 'WRITES', 'PUBLISHES', 'SUBSCRIBES', 'CONNECTS_TO', 'RUNS_ON', 'HAS_MEMBER')
  OR type = 'CONTAINS' AND s.kind IN ('Cluster', 'Cache', 'Database', 'Middleware', 'Queue', 'Component') AND t.kind NOT IN ('System', 'Layer', 'Function', 'API')""")
def traversable_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return _rows(graph_edits.traversable(edges, nodes))


@_query(f"""WITH {_G}, e AS (SELECT source, target, 'TEMPORALLY_PRECEDES' AS type FROM e0 WHERE type = 'AFFECTS' UNION ALL SELECT source, target, 'CO_OCCURS_WITH' FROM e0 WHERE type = 'AFFECTS' UNION ALL SELECT * FROM e0) SELECT source, target, type FROM e WHERE type <> 'CO_OCCURS_WITH'""")
def written_edges(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    some = edges.filter("type = 'AFFECTS'")
    return graph_edits.written(edges.unionByName(some.withColumn("type", F.lit("TEMPORALLY_PRECEDES"))).unionByName(some.withColumn("type", F.lit("CO_OCCURS_WITH"))))


@_query(f"WITH {_G} SELECT id, name, kind IN ('Cluster') OR kind IN ('Cache', 'Database', 'Middleware', 'Queue', 'Component', 'Service') AND regexp_matches(lower(name), 'cluster') AS aggregate, CASE WHEN kind IN ('Service', 'Cluster') THEN kind ELSE 'Component' END AS safe FROM n0 WHERE project = 'p1' AND contains(lower(id || ' ' || name || ' ' || kind || ' ' || project || ' ' || source_file), 'c:1')")
def faceted_nodes(spark, sf_dir):
    found = graph_edits.faceted(_graph(spark, sf_dir)[0], project="p1", query="C:1")
    return found.select("id", "name", graph_edits.is_aggregate(F.col("kind"), F.col("name")).alias("aggregate"), graph_edits.safe_kind(F.col("kind"), ("Service", "Cluster")).alias("safe"))


_NEW = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '-new' END AS name, 'u:' || CAST(n_nationkey AS VARCHAR) AS id, 'Service' AS kind, 'p9' AS project, 'up' AS source_file, FALSE AS observed FROM nation"


@_query(f"WITH {_G}, u AS ({_NEW}) SELECT id, name, kind FROM n0 WHERE name NOT IN (SELECT name FROM u) UNION ALL SELECT id, name, kind FROM u")
def node_upsert(spark, sf_dir):
    new = spark.sql(_NEW.replace("VARCHAR", "STRING").replace("FROM nation", "FROM {n}"), n=_table(spark, sf_dir, "nation"))
    return graph_edits.upsert_nodes(_graph(spark, sf_dir)[0], new.unionByName(new)).select("id", "name", "kind")


_FRESH = "SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'n:' || CAST(n_nationkey AS VARCHAR) WHEN n_nationkey % 3 = 1 THEN 'gone:' || CAST(n_nationkey AS VARCHAR) ELSE '' END AS target, 'USES' AS type FROM nation"


def _with_fresh(spark, sf_dir):
    nodes, edges = _cut_graph(spark, sf_dir)
    fresh = spark.sql(_FRESH.replace("VARCHAR", "STRING").replace("FROM nation", "FROM {n}"), n=_table(spark, sf_dir, "nation"))
    return nodes, edges, graph_edits.insert_edges(edges, fresh.unionByName(fresh).unionByName(edges))


_AFTER = f"{_G}, fresh AS ({_FRESH}), e1 AS (SELECT * FROM e0 UNION ALL SELECT * FROM fresh WHERE target <> '' AND source <> target)"


@_query(f"WITH {_AFTER} SELECT source, target, type FROM e1")
def edge_insert(spark, sf_dir):
    return _rows(_with_fresh(spark, sf_dir)[2])


@_query(f"WITH {_AFTER} SELECT DISTINCT x AS id, x AS name, 'Component' AS kind FROM (SELECT source AS x FROM e1 UNION SELECT target FROM e1) WHERE x NOT IN (SELECT id FROM n0)")
def missing_ends(spark, sf_dir):
    nodes, _, edges = _with_fresh(spark, sf_dir)
    return graph_edits.missing_ends(nodes, edges).select("id", "name", "kind")


@_query(f"WITH {_G}, g AS (SELECT id FROM n0 WHERE kind = 'Cluster') {_N} FROM n0 WHERE id NOT IN (SELECT id FROM g) UNION ALL {_E} FROM e0 WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)")
def node_delete(spark, sf_dir):
    nodes, edges = _cut_graph(spark, sf_dir)
    return _halves(*graph_edits.delete_nodes(nodes, edges, nodes.filter("kind = 'Cluster'")))


@_query(f"WITH {_G} SELECT source, target, CASE WHEN type = 'HAS_MEMBER' THEN 'HOSTED_ON' ELSE type END AS type FROM e0")
def edge_replace(spark, sf_dir):
    edges = lineage.cut(_graph(spark, sf_dir)[1])
    old = edges.filter("type = 'HAS_MEMBER'")
    return _rows(graph_edits.replace_edges(edges, old, old.withColumn("type", F.lit("HOSTED_ON"))))


@_query(f"WITH {_G} SELECT source, target, type FROM e0 WHERE NOT (type = 'CONTAINS' AND source = 'r:1')")
def edge_delete(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return _rows(graph_edits.delete_edges(edges, edges.filter("type = 'CONTAINS' and source = 'r:1'")))


@_query(f"""WITH {_G}, m AS (SELECT id AS old, CASE WHEN kind = 'Cluster' THEN 'n:0' ELSE id || '!' END AS new FROM n0 WHERE kind IN ('Cluster', 'System')),
  r AS (SELECT coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, type FROM e0 LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target) SELECT DISTINCT source, target, type FROM r WHERE source <> target""")
def edge_rename(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    names = nodes.filter("kind in ('Cluster', 'System')").select(F.col("id").alias("old"), F.when(F.col("kind") == "Cluster", "n:0").otherwise(F.concat("id", F.lit("!"))).alias("new"))
    return graph_edits.rename(edges, names)


@_query(f"""WITH {_G}, l AS (SELECT * FROM n0 WHERE NOT (kind IN {_DYN} AND contains(name, ':b1:'))), e AS (SELECT * FROM e0 WHERE source NOT IN (SELECT id FROM n0 WHERE kind IN {_DYN} AND contains(name, ':b1:')) AND target NOT IN (SELECT id FROM n0 WHERE kind IN {_DYN} AND contains(name, ':b1:')))
  {_N} FROM l WHERE kind NOT IN ('Trace', 'Exception') OR id IN (SELECT source FROM e UNION SELECT target FROM e) UNION ALL {_E} FROM e""")
def batch_delete(spark, sf_dir):
    return _halves(*graph_edits.delete_batch(*_cut_graph(spark, sf_dir), "b1"))


@_query(f"""WITH {_G}, ends AS (SELECT source AS id FROM e0 UNION SELECT target FROM e0), j AS (SELECT e.*, s.id AS s, t.id AS t, s.project AS sp, t.project AS tp FROM e0 e LEFT JOIN n0 s ON s.id = source LEFT JOIN n0 t ON t.id = target)
  SELECT 'orphan_nodes' AS "check", count(*) AS n FROM n0 WHERE id NOT IN (SELECT id FROM ends) UNION ALL SELECT 'dangling_edges', count(*) FROM j WHERE s IS NULL OR t IS NULL
  UNION ALL SELECT 'duplicate_edges', count(*) FROM (SELECT 1 FROM e0 GROUP BY source, target, type HAVING count(*) > 1) UNION ALL SELECT 'unscoped_nodes', count(*) FROM n0 WHERE project = ''
  UNION ALL SELECT 'cross_project_edges', count(*) FROM j WHERE sp <> tp UNION ALL SELECT 'unknown_projects', count(*) FROM n0 WHERE project NOT IN ('', 'p0', 'p1')""")
def graph_quality(spark, sf_dir):
    return graph_edits.quality(*_cut_graph(spark, sf_dir), spark.range(2).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project")))


@_query(f"""WITH {_G}, o AS (SELECT * FROM n0 WHERE id NOT IN (SELECT source FROM e0 WHERE type <> 'CONTAINS' UNION SELECT target FROM e0 WHERE type <> 'CONTAINS'))
  SELECT id, CASE WHEN project = '' THEN 'unscoped' WHEN kind IN {_DYN} THEN 'dynamic' WHEN source_file = 'manual' THEN 'manual' WHEN source_file <> '' THEN 'imported' ELSE 'leftover' END AS cause,
  CASE WHEN project = '' THEN 'high' WHEN kind IN {_DYN} THEN 'low' WHEN source_file <> '' THEN 'medium' ELSE 'high' END AS risk FROM o""")
def orphan_reasons(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph_edits.orphan_diagnosis(graph.orphan_nodes(nodes, edges.filter("type <> 'CONTAINS'")))


@_query(f"""WITH {_G}, c AS (SELECT lower(a) AS alias, min(id) AS id FROM (SELECT id, id AS a FROM n0 UNION ALL SELECT id, name FROM n0) GROUP BY 1), q AS (SELECT DISTINCT x AS name FROM (SELECT lower(n_name) AS x FROM nation UNION ALL SELECT 'n:' || n_nationkey FROM nation UNION ALL SELECT 'nobody' FROM nation))
  SELECT q.name, coalesce(n0.id, c.id) AS id FROM q LEFT JOIN n0 ON n0.id = q.name LEFT JOIN c ON c.alias = lower(q.name)""")
def catalog_ids(spark, sf_dir):
    nodes = _graph(spark, sf_dir)[0]
    nation = _table(spark, sf_dir, "nation")
    asked = nation.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), F.lit("nobody"))).alias("name"))
    return graph_edits.catalog_ids(asked, nodes)


_PATHS = f"""WITH RECURSIVE {_G}, st AS (SELECT source AS a, target AS b FROM e0 WHERE type <> 'CALLS' UNION SELECT target, source FROM e0 WHERE type <> 'CALLS'),
p AS (SELECT id AS node, [id] AS path FROM n0 WHERE id IN ('s:1', 'r:2') UNION ALL SELECT b, list_append(path, b) FROM p JOIN st ON a = node WHERE len(path) < 5 AND NOT list_contains(path, b)),
s AS (SELECT path[1] AS seed, node, arg_min(path, struct_pack(a := len(path), b := path)) AS path FROM p GROUP BY 1, 2)"""


def _paths(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph_edits.shortest_paths(edges.filter("type <> 'CALLS'"), nodes.filter("id in ('s:1', 'r:2')").select("id"), 4, undirected=True)


@_query(f"{_PATHS} SELECT seed, node, array_to_string(path, '>') AS path FROM s")
def shortest_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("seed", "node", F.array_join("path", ">").alias("path"))


@_query(f"{_PATHS} SELECT seed, node, i AS step, path[len(path) - i] AS cause, path[len(path) - i - 1] AS effect FROM (SELECT *, unnest(range(len(path) - 1)) AS i FROM s)")
def causal_steps(spark, sf_dir):
    return graph_edits.causal_steps(_paths(spark, sf_dir))


@_query(f"""WITH RECURSIVE {_G}, m AS (SELECT source AS parent, target AS member FROM e0 WHERE type IN ('HAS_MEMBER', 'CONTAINS')), r AS (SELECT id AS seed, id AS node, CAST(0 AS BIGINT) AS distance FROM n0 WHERE kind = 'System' UNION SELECT seed, member, distance + 1 FROM r JOIN m ON parent = node WHERE distance < 6)
  SELECT seed, node, min(distance) AS distance FROM r GROUP BY seed, node""")
def cluster_reach(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph_edits.members(graph.membership(edges), nodes.filter("kind = 'System'"))


@_query(f"WITH {_G} SELECT source AS parent, min(target) AS member FROM e0 WHERE type IN ('HAS_MEMBER', 'CONTAINS') GROUP BY source HAVING count(DISTINCT target) = 1")
def single_members(spark, sf_dir):
    return graph_edits.single_members(graph.membership(_graph(spark, sf_dir)[1]))


@_query(f"""WITH {_G} SELECT 'node' AS item, id AS a, name AS b, kind AS c, project, CASE WHEN source_file = '' THEN 'manual_import' ELSE source_file END AS source_file, observed FROM n0
  UNION ALL SELECT 'edge', source, target, type, NULL, NULL, NULL FROM e0""")
def graph_round_trip(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    sent = lineage.cut(graph_edits.export(nodes.withColumn("source_file", F.when(F.col("source_file") != "", F.col("source_file"))), edges))
    nodes, edges = graph_edits.imported(sent)
    both = _halves(nodes, edges)
    return both.join(nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"), "project", "source_file", "observed"), ["item", "a"], "left")
