"""The graph that an analysis adds to an architecture: incidents with their services, exceptions, traces, log events, root
candidates and hypotheses, as nodes (id, kind, description) and edges (source, target, type, place).

Each kind of node and edge is one projection of its table, and the projections are put together; of equal edges the one of
least place stays. Timelines and chains come in as the few rows that were selected for an incident, so windows by incident
are bounded. Null and empty names give neither node nor edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules
from . import compression
from .graph_edits import DYNAMIC
from .lineage import cut

#: Hypotheses, exception classes and root candidates of an incident that are written.
MOST = 3
# The relations that lead from an incident to its own subgraph, and what stands for an unknown root cause.
DIRECT = ("ROOT_SERVICE", "OBSERVED_AT", "HAS_EXCEPTION", "HAS_TRACE", "HAS_HYPOTHESIS", "SUSPECTED_ROOT_CAUSE")
UNKNOWN_CAUSE = "未提取到明确底层异常"


def _id(kind: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _spread(df: DataFrame, structs: list[Column]) -> DataFrame:
    """A row for each struct of each row, from one pass over the table."""
    return df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def _nodes(parts: list[tuple[DataFrame, list[tuple]]]) -> DataFrame:
    """Nodes of tables, each with its (id, kind, description); one of each id with the least description."""
    node = lambda i, kind, d: F.struct(i.alias("id"), F.lit(kind).alias("kind"), F.coalesce(d, F.lit("")).alias("description"))
    rows = _all([_spread(df, [node(*x) for x in made]) for df, made in parts]).filter("id <> ''")
    return rows.groupBy("id").agg(F.min(F.struct("kind", "description")).alias("x")).select("id", "x.*")


def _edges(parts: list[tuple[DataFrame, list[tuple]]]) -> DataFrame:
    """Edges of tables, each with its (source, target, type, place), without those that lack an end or lead back."""
    edge = lambda a, b, kind, p: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), p.cast("long").alias("place"))
    rows = _all([_spread(df, [edge(*x) for x in made]) for df, made in parts])
    return rows.filter("source <> '' and target <> '' and source <> target").groupBy("source", "target", "type").agg(F.min("place").alias("place"))


def dynamic_graph(incidents: DataFrame, classes: DataFrame, timeline: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of incidents. incidents: (incident, service, trace_id, root_cause); classes: (incident, place, class);
    timeline: (incident, place, event_id, level, service, message, class); candidates: (incident, place, service, message).

    Services that follow each other in a timeline are linked whatever events without a service stand between them. Each
    table is gone through once for all its nodes and once for all its edges."""
    own, none = _id("Incident", "incident"), F.lit(0)
    incidents = incidents.withColumn("root_cause", F.coalesce(F.when(F.col("root_cause") != "", F.col("root_cause")), F.lit(UNKNOWN_CAUSE)))
    classes, candidates = classes.filter(F.col("place") <= MOST), candidates.filter(F.col("place") <= MOST)
    event = _id("LogEvent", "incident", F.lpad(F.col("place").cast("string"), 3, "0"))
    candidate = _id("RootCandidate", "incident", F.lpad(F.col("place").cast("string"), 2, "0"))
    trace = F.when(F.col("trace_id") != "", _id("Trace", "trace_id"))
    root, named = text_rules.exception_node(F.col("root_cause")), F.when(F.col("class") != "", text_rules.exception_node(F.col("class")))
    backward = Window.partitionBy("incident").orderBy(F.col("place").desc())
    rows = timeline.withColumn("event", event)
    # Read backward, what comes next is what came last: one running pass, however long a timeline is.
    next_named = F.last(F.when(F.col("service") != "", F.col("service")), ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    ahead = rows.withColumns({"later": F.lag("event").over(backward), "later_service": next_named}).join(incidents.select("incident", trace.alias("trace")), "incident", "left")
    col = F.col
    nodes = _nodes([
        (incidents, [(own, "Incident", F.concat_ws(" / ", "service", F.substring("root_cause", 1, 180))), (col("service"), "Service", F.lit("")), (root, "Exception", F.substring("root_cause", 1, 500)), (trace, "Trace", col("trace_id"))]),
        (classes, [(named, "Exception", col("class"))]),
        (rows, [(named, "Exception", col("class")), (col("event"), "LogEvent", F.concat_ws(" ", "level", "service", F.substring("message", 1, 220))), (col("service"), "Service", F.lit(""))]),
        (candidates, [(candidate, "LogEvent", F.substring("message", 1, 500)), (col("service"), "Service", F.lit(""))]),
    ])
    place = col("place")
    edges = _edges([
        (incidents, [(own, col("service"), "ROOT_SERVICE", none), (own, col("service"), "OBSERVED_AT", none), (own, root, "HAS_EXCEPTION", none), (own, trace, "HAS_TRACE", none)]),
        (classes, [(own, named, "HAS_EXCEPTION", place)]),
        (ahead, [(own, col("event"), "HAS_EVENT", place), (col("trace"), col("event"), "HAS_EVENT", place), (col("event"), named, "RAISES", place), (col("service"), col("event"), "EMITS", place),
                 (F.when(col("service") != "", col("service")), col("later_service"), "CO_OCCURS_IN_TRACE", place), (col("event"), col("later"), "TEMPORALLY_PRECEDES", place)]),
        (candidates, [(own, candidate, "TRIGGERED_BY", place), (col("service"), candidate, "EMITS", place)]),
    ])
    return nodes, edges


def hypothesis_graph(hypotheses: DataFrame, nodes: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of hypotheses (incident, rank, candidate, summary, chain), the first `most` of an incident.

    Edges lead only to nodes that are known: candidates, the rest of a chain, and the first root candidate as evidence."""
    found = hypotheses.filter(F.col("rank") <= most)
    own, node = _id("Incident", "incident"), _id("RCAHypothesis", "incident", F.lpad(F.col("rank").cast("string"), 2, "0"))
    rest = found.select("incident", "rank", F.explode(F.slice("chain", 2, F.greatest(F.size("chain"), F.lit(1)))).alias("affected"))
    rank, candidate = F.col("rank"), F.col("candidate")
    edges = _edges([
        (found, [(own, node, "HAS_HYPOTHESIS", rank), (node, candidate, "CANDIDATE_CAUSE", rank), (F.when(rank == 1, own), candidate, "SUSPECTED_ROOT_CAUSE", rank), (node, _id("RootCandidate", "incident", F.lit("01")), "SUPPORTED_BY", rank)]),
        (rest, [(node, F.col("affected"), "AFFECTS", rank)]),
    ])
    made = _nodes([(found, [(node, "RCAHypothesis", F.col("summary"))])])
    known = nodes.select(F.col("id").alias("target")).distinct().withColumn("_known", F.lit(True))
    return made, edges.join(known, "target", "left").filter((F.col("type") == "HAS_HYPOTHESIS") | F.col("_known")).select(edges.columns)


def stored_hypotheses(edges: DataFrame, incident: str | None = None) -> DataFrame:
    """incident, hypothesis, rank, candidate of what hypothesis_graph() wrote, in the order of ranks."""
    has = edges.filter("type = 'HAS_HYPOTHESIS'").select(F.col("source").alias("incident"), F.col("target").alias("hypothesis"), F.col("place").alias("rank"))
    has = has.filter(F.col("incident") == incident) if incident else has
    cause = edges.filter("type = 'CANDIDATE_CAUSE'").select(F.col("source").alias("hypothesis"), F.col("target").alias("candidate"))
    return has.join(cause, "hypothesis", "left").select("incident", "hypothesis", "rank", "candidate")


def incident_part(nodes: DataFrame, edges: DataFrame, incidents: DataFrame, events: int = 0) -> tuple[DataFrame, DataFrame]:
    """incident, id of the nodes that show an incident, and the edges between them, for each of incidents (incident).

    Shown are what its own relations touch, all neighbours of its hypotheses and, if asked, its first events with their
    neighbours in time and in the architecture; other dynamic nodes of events are left out."""
    start = incidents.select("incident", F.col("incident").alias("id")).distinct()
    links = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "type").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "type"))
    kinds = nodes.select("id", "kind").distinct()
    own = start.join(links.filter(F.col("type").isin(*DIRECT)), "id").select("incident", F.col("other").alias("id"))
    guessed = own.join(kinds.filter("kind = 'RCAHypothesis'"), "id", "left_semi")
    parts = [start, own, guessed.join(links, "id").select("incident", F.col("other").alias("id"))]
    if events:
        has = edges.filter("type = 'HAS_EVENT'").join(start.select(F.col("id").alias("source")), "source", "left_semi")
        shown = compression.best(has, ["source"], ["place", "target"], events).select(F.col("source").alias("incident"), F.col("target").alias("id"))
        near = shown.join(links, "id").join(kinds.select(F.col("id").alias("other"), "kind"), "other")
        near = near.filter((F.col("type") == "TEMPORALLY_PRECEDES") | ~F.col("kind").isin(*DYNAMIC)).select("incident", F.col("other").alias("id"))
        parts += [shown, near]
    found = _all(parts).distinct().join(kinds.select("id"), "id", "left_semi").select("incident", "id")
    found = cut(found)
    return found, _between(edges, found)


def _between(edges: DataFrame, found: DataFrame) -> DataFrame:
    """incident and edge for each incident that has both ends of the edge among its nodes (incident, id).

    An edge meets the incidents of that end which fewer have, and then looks whether they have the other. From the end of a
    service, which most incidents have and most events lead to, it would meet them all."""
    held = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    count = lambda end: held.select(F.col("id").alias(end), F.col("n").alias(f"_{end}"))
    shown = edges.join(count("source"), "source").join(count("target"), "target")
    rarer = F.col("_source") <= F.col("_target")
    shown = shown.select(*edges.columns, F.when(rarer, F.col("source")).otherwise(F.col("target")).alias("id"), F.when(rarer, F.col("target")).otherwise(F.col("source")).alias("other"))
    met = shown.join(found, "id").join(found.select("incident", F.col("id").alias("other")), ["incident", "other"])
    return met.select("incident", *edges.columns)
