"""Queries of the graph that analyses add, with their DuckDB equivalents: incidents are traces of the log that have an error."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import incident_graph, lineage
from .registry import _EV, _events, _query

_NAMED = r"regexp_extract(message, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1)"
_G = rf"""{_EV}, tl AS (SELECT trace_id AS incident, row_number() OVER (PARTITION BY trace_id ORDER BY event_s, event_id) AS place, event_id, level, CASE WHEN event_id % 11 = 0 THEN '' ELSE service END AS service, message, {_NAMED} AS class,
  level IN ('ERROR', 'FATAL') AS bad FROM ev WHERE trace_id <> ''), inc AS (SELECT incident, arg_min(service, place) FILTER (bad) AS service, CASE WHEN hash = 0 THEN '' ELSE incident END AS trace_id, root_cause FROM (
    SELECT incident, place, service, bad, CAST(substr(incident, 4) AS INT) % 3 AS hash, arg_min(CASE WHEN place % 2 = 0 THEN '' ELSE message END, CASE WHEN bad THEN place END) OVER (PARTITION BY incident) AS root_cause FROM tl) GROUP BY ALL HAVING count(*) FILTER (bad) > 0),
lines AS (SELECT tl.*, 'LogEvent:' || incident || ':' || lpad(CAST(place AS VARCHAR), 3, '0') AS event, CASE WHEN class <> '' THEN 'Exception:' || class ELSE '' END AS named FROM tl WHERE incident IN (SELECT incident FROM inc)),
sv AS (SELECT *, lead(service) OVER (PARTITION BY incident ORDER BY place) AS later FROM lines WHERE service <> ''), cd AS (SELECT *, 'RootCandidate:' || incident || ':' || lpad(CAST(rank AS VARCHAR), 2, '0') AS node FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY place) AS rank FROM lines WHERE bad) WHERE rank <= 3),
ic AS (SELECT *, 'Incident:' || incident AS own, CASE WHEN trace_id <> '' THEN 'Trace:' || trace_id ELSE '' END AS trace, 'Exception:' || CASE WHEN root_cause = '' THEN '未提取到明确底层异常' WHEN regexp_matches(root_cause, '[A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error)') THEN regexp_extract(root_cause, '([A-Za-z_$][A-Za-z0-9_.$]*(Exception|Error))', 1) ELSE substr(root_cause, 1, 48) END AS root FROM inc),
hy AS (SELECT incident, rank, service AS candidate, 'RCAHypothesis:' || incident || ':0' || rank AS node, list(service) OVER (PARTITION BY incident ORDER BY rank) AS chain FROM cd),
ed AS (SELECT own AS source, service AS target, 'ROOT_SERVICE' AS type, 0 AS place FROM ic UNION ALL SELECT own, service, 'OBSERVED_AT', 0 FROM ic UNION ALL SELECT own, root, 'HAS_EXCEPTION', 0 FROM ic UNION ALL SELECT own, trace, 'HAS_TRACE', 0 FROM ic
  UNION ALL SELECT own, named, 'HAS_EXCEPTION', rank FROM cd JOIN ic USING (incident) UNION ALL SELECT own, event, 'HAS_EVENT', place FROM lines JOIN ic USING (incident) UNION ALL SELECT trace, event, 'HAS_EVENT', place FROM lines JOIN ic USING (incident)
  UNION ALL SELECT event, named, 'RAISES', place FROM lines UNION ALL SELECT service, event, 'EMITS', place FROM lines UNION ALL SELECT service, later, 'CO_OCCURS_IN_TRACE', place FROM sv
  UNION ALL SELECT event, lead(event) OVER (PARTITION BY incident ORDER BY place), 'TEMPORALLY_PRECEDES', place FROM lines UNION ALL SELECT own, node, 'TRIGGERED_BY', rank FROM cd JOIN ic USING (incident) UNION ALL SELECT service, node, 'EMITS', rank FROM cd),
ge AS (SELECT source, target, type, min(place) AS place FROM ed WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
nd AS (SELECT own AS id, 'Incident' AS kind FROM ic UNION SELECT service, 'Service' FROM ic UNION SELECT root, 'Exception' FROM ic UNION SELECT trace, 'Trace' FROM ic UNION SELECT named, 'Exception' FROM lines UNION SELECT event, 'LogEvent' FROM lines
  UNION SELECT service, 'Service' FROM lines UNION SELECT node, 'LogEvent' FROM cd),
gn AS (SELECT id, kind FROM nd WHERE id <> ''),
he AS (SELECT 'Incident:' || incident AS source, node AS target, 'HAS_HYPOTHESIS' AS type, rank AS place FROM hy UNION ALL SELECT * FROM (SELECT node, candidate, 'CANDIDATE_CAUSE', rank FROM hy UNION ALL SELECT 'Incident:' || incident, candidate, 'SUSPECTED_ROOT_CAUSE', rank FROM hy WHERE rank = 1
    UNION ALL SELECT node, unnest(chain[2:]), 'AFFECTS', rank FROM hy UNION ALL SELECT node, 'RootCandidate:' || incident || ':01', 'SUPPORTED_BY', rank FROM hy) x(source, target, type, place) WHERE target IN (SELECT id FROM gn)),
hg AS (SELECT source, target, type, min(place) AS place FROM he WHERE target <> '' GROUP BY ALL)"""


def _analysed(spark, sf_dir):
    """Incidents, classes, timelines and root candidates of the traces that have an error: one pass over the log, checkpointed."""
    trace = Window.partitionBy("trace_id")
    along = trace.orderBy("event_s", "event_id")
    service, bad = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("service")), F.col("level").isin("ERROR", "FATAL")
    rows = _events(spark, sf_dir).filter("trace_id <> ''").select(
        F.col("trace_id").alias("incident"), F.row_number().over(along).alias("place"), "event_id", "level", service.alias("service"), "message", F.col("exception_class").alias("class"), bad.alias("bad"),
        F.max(bad).over(trace).alias("failed"), F.when(bad, F.sum(bad.cast("int")).over(along)).alias("rank"),
    )
    timeline = lineage.cut(rows.filter("failed").drop("failed"))
    first = timeline.filter("rank = 1").select("incident", "service", F.when(F.col("place") % 2 == 0, "").otherwise(F.col("message")).alias("root_cause"))
    incidents = first.withColumn("trace_id", F.when(F.substring("incident", 4, 20).cast("int") % 3 == 0, "").otherwise(F.col("incident")))
    ranked = timeline.filter("bad").withColumn("place", F.col("rank"))
    return incidents, ranked.select("incident", "place", "class"), timeline.drop("bad", "rank"), ranked.select("incident", "place", "service", "message")


def _hypotheses(spark, sf_dir):
    incidents, classes, timeline, candidates = _analysed(spark, sf_dir)
    nodes, edges = incident_graph.dynamic_graph(incidents, classes, timeline, candidates)
    nodes = lineage.cut(nodes)
    said = candidates.filter("place <= 3").select("incident", F.col("place").alias("rank"), F.col("service").alias("candidate"), F.col("message").alias("summary"))
    said = lineage.cut(said.withColumn("chain", F.collect_list("candidate").over(Window.partitionBy("incident").orderBy("rank"))))
    return nodes, edges, *incident_graph.hypothesis_graph(said, nodes)


@_query(f"WITH {_G} SELECT * FROM ge")
def dynamic_edges(spark, sf_dir):
    return incident_graph.dynamic_graph(*_analysed(spark, sf_dir))[1]


@_query(f"WITH {_G} SELECT * FROM gn")
def dynamic_nodes(spark, sf_dir):
    return incident_graph.dynamic_graph(*_analysed(spark, sf_dir))[0].select("id", "kind")


@_query(f"WITH {_G} SELECT * FROM hg")
def hypothesis_edges(spark, sf_dir):
    return _hypotheses(spark, sf_dir)[3]


@_query(f"WITH {_G} SELECT a.source AS incident, a.target AS hypothesis, a.place AS rank, b.target AS candidate FROM hg a LEFT JOIN hg b ON b.source = a.target AND b.type = 'CANDIDATE_CAUSE' WHERE a.type = 'HAS_HYPOTHESIS'")
def stored_hypotheses(spark, sf_dir):
    return incident_graph.stored_hypotheses(lineage.cut(_hypotheses(spark, sf_dir)[3]))


@_query(f"""WITH {_G}, an AS (SELECT id, kind FROM gn UNION SELECT node, 'RCAHypothesis' FROM hy), ae AS (SELECT * FROM ge UNION ALL SELECT * FROM hg), li AS (SELECT source AS id, target AS other, type FROM ae UNION ALL SELECT target, source, type FROM ae), st AS (SELECT own AS incident FROM ic),
  ow AS (SELECT incident, other AS id FROM st JOIN li ON li.id = incident WHERE type IN ('ROOT_SERVICE', 'OBSERVED_AT', 'HAS_EXCEPTION', 'HAS_TRACE', 'HAS_HYPOTHESIS', 'SUSPECTED_ROOT_CAUSE')),
  gu AS (SELECT incident, other AS id FROM ow JOIN an ON an.id = ow.id AND kind = 'RCAHypothesis' JOIN li ON li.id = ow.id),
  sh AS (SELECT source AS incident, target AS id FROM ae WHERE type = 'HAS_EVENT' AND source LIKE 'Incident:%' QUALIFY row_number() OVER (PARTITION BY source ORDER BY place, target) <= 3),
  ne AS (SELECT incident, other AS id FROM sh JOIN li ON li.id = sh.id JOIN an ON an.id = other WHERE type = 'TEMPORALLY_PRECEDES' OR kind NOT IN ('Incident', 'Trace', 'LogEvent', 'Exception', 'Window', 'Metric', 'RCAHypothesis', 'UnresolvedDependency')),
  fo AS (SELECT * FROM (SELECT incident, incident AS id FROM st UNION SELECT * FROM ow UNION SELECT * FROM gu UNION SELECT * FROM sh UNION SELECT * FROM ne) WHERE id IN (SELECT id FROM an))
  SELECT a.incident, source, target, type, place FROM ae JOIN fo a ON a.id = source JOIN fo b ON b.id = target AND b.incident = a.incident""")
def incident_parts(spark, sf_dir):
    nodes, edges, made, more = _hypotheses(spark, sf_dir)
    nodes, edges = nodes.unionByName(made), lineage.cut(edges.unionByName(more))
    incidents = nodes.filter("kind = 'Incident'").select(F.col("id").alias("incident"))
    return incident_graph.incident_part(nodes, edges, incidents, events=3)[1]
