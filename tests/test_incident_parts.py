"""Incidents that share a service with all others."""

from opslens.operators import incident_graph


def _join_rows(node):
    """Rows out of each join of an executed plan."""
    rows = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    children = node.children()
    return rows + [n for i in range(children.size()) for n in _join_rows(children.apply(i))]


def test_a_service_of_all_incidents_does_not_meet_all_events(spark):
    n = 200
    edges = [(f"Incident:{k}", "hub", "ROOT_SERVICE", 0) for k in range(n)] + [(f"Incident:{k}", f"LogEvent:{k}", "HAS_EVENT", 1) for k in range(n)] + [("hub", f"LogEvent:{k}", "EMITS", 1) for k in range(n)] + [("hub", "other", "CALLS", 1)]
    nodes = [(f"{kind}:{k}", kind) for k in range(n) for kind in ("Incident", "LogEvent")] + [("hub", "Service"), ("other", "Service")]
    nodes, edges = spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "source string, target string, type string, place long")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        part = incident_graph.incident_part(nodes, edges, nodes.filter("kind = 'Incident'").selectExpr("id as incident"), events=3)[1]
        rows = part.collect()
        most = max(_join_rows(part._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {x for k in range(n) for x in ((f"Incident:{k}", f"Incident:{k}", "hub", "ROOT_SERVICE"), (f"Incident:{k}", f"Incident:{k}", f"LogEvent:{k}", "HAS_EVENT"), (f"Incident:{k}", "hub", f"LogEvent:{k}", "EMITS"))}
    assert {(r.incident, r.source, r.target, r.type) for r in rows} == want and len(rows) == len(want)
    assert most < 10 * n
