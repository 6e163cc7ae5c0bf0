"""What is kept of a decision on an incident: labels along its chain, the facts that are promoted, and what it is told of the architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules
from . import graph_edits
from .grounding import STAGES
from .lineage import cut, small

# How many hypotheses and descriptions a decision is told of, and how long labels may be.
MOST_HYPOTHESES, MOST_DESCRIPTIONS = 8, 40
LABEL, EXPLANATION, STAGE = 80, 500, 40
# What stands for an unknown service and cause, and the beginning of a cause that a title shows.
NO_SERVICE, NO_CAUSE, TITLE_CAUSE = "未知服务", "未提取到明确异常", 100
HYPOTHESIS_FIELDS = ("rank", "candidate", "kind", "mode", "score", "status", "chain", "missing")


def _said(name: str, most: int | None = None) -> Column:
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    return F.substring(text, 1, most) if most else text


def display_chains(chains: DataFrame, labels: DataFrame) -> DataFrame:
    """decision, place, node, label, explanation, stage of every node of chains (decision, chain: array).

    labels: (decision, place, node, label, explanation, stage). Of several for a node the last counts, of equal places the
    greatest by its texts; nodes off the chain are left out. What is not said is the node's name, nothing, and the stage by place: cause first, then spread, entry last.
    Blank nodes of a chain go; a null chain has none."""
    nodes = F.filter(F.transform("chain", lambda x: F.trim(x)), lambda x: x != "")
    listed = chains.select("decision", nodes.alias("_nodes")).select("decision", F.size("_nodes").alias("_n"), F.posexplode("_nodes").alias("_place", "node"))
    said = F.struct(F.coalesce(F.nullif(_said("label", LABEL), F.lit("")), F.substring(_said("node"), 1, LABEL)).alias("label"), _said("explanation", EXPLANATION).alias("explanation"), _said("stage", STAGE).alias("stage"))
    last = labels.filter(_said("node") != "").groupBy("decision", _said("node").alias("node")).agg(F.max_by(said, F.struct("place", said)).alias("x"))
    by_place = F.when(F.col("_place") == 0, F.lit(STAGES[0])).when(F.col("_place") == F.col("_n") - 1, F.lit(STAGES[2])).otherwise(F.lit(STAGES[1]))
    rows = listed.join(last, ["decision", "node"], "left")
    return rows.select(
        "decision", F.col("_place").alias("place"), "node", F.coalesce("x.label", "node").alias("label"), F.coalesce("x.explanation", F.lit("")).alias("explanation"), F.coalesce(F.nullif(F.col("x.stage"), F.lit("")), by_place).alias("stage")
    )


def compacted(hypotheses: DataFrame, most: int = MOST_HYPOTHESES) -> DataFrame:
    """incident, hypotheses: of each incident the first ones by rank, as an array of structs of the allowed fields that there are."""
    fields = [c for c in HYPOTHESIS_FIELDS if c in hypotheses.columns]
    first = hypotheses.withColumn("_at", F.row_number().over(Window.partitionBy("incident").orderBy("rank", "candidate"))).filter(F.col("_at") <= most)
    return first.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*fields).alias("h")))), lambda x: x["h"]).alias("hypotheses"))


def promoted(incidents: DataFrame, hypotheses: DataFrame, decisions: DataFrame) -> DataFrame:
    """incident, title, severity, candidate, confidence, mode, chain, decided of incidents (incident, service, cause).

    hypotheses: (incident, rank, candidate, mode, score, chain: array); decisions: (incident, node, candidate, mode, confidence,
    path: array of nodes), one an incident. A decision counts where it names a node of the architecture and a path; else the
    first hypothesis does, of equal ranks the least by its columns, and without one the service that failed."""
    top = hypotheses.groupBy("incident").agg(F.min_by(F.struct("candidate", "mode", F.col("score").alias("confidence"), F.col("chain").alias("path")), F.struct("rank", "candidate", "mode", "score", "chain")).alias("top"))
    steps = F.filter(F.transform("path", lambda x: F.trim(x)), lambda x: x != "")
    made = decisions.withColumn("path", steps).filter((_said("node") != "") & (F.size("path") > 0)).select("incident", F.struct("candidate", "mode", "confidence", "path").alias("made"))
    rows = incidents.join(top, "incident", "left").join(made, "incident", "left").withColumn("decided", F.col("made").isNotNull())
    either = lambda c: F.when(F.col("decided"), F.col(f"made.{c}")).otherwise(F.col(f"top.{c}"))
    service = F.coalesce(F.nullif("service", F.lit("")), F.lit(NO_SERVICE))
    confidence = F.coalesce("made.confidence", "top.confidence", F.lit(0.0)).cast("double")
    return rows.select(
        "incident", F.concat(service, F.lit("："), F.substring(F.coalesce(F.nullif("cause", F.lit("")), F.lit(NO_CAUSE)), 1, TITLE_CAUSE)).alias("title"), text_rules.severity(confidence).alias("severity"),
        F.when(F.col("decided"), F.coalesce("made.candidate", F.lit(""))).otherwise(F.coalesce(F.nullif("top.candidate", F.lit("")), service)).alias("candidate"), confidence.alias("confidence"), F.coalesce(either("mode"), F.lit("")).alias("mode"),
        F.coalesce(either("path"), F.array().cast("array<string>")).alias("chain"), "decided",
    )


def focus(named: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = MOST_DESCRIPTIONS) -> DataFrame:
    """incident, place, id, description: the described nodes that incidents (incident, name: a name or id) speak of, and their
    neighbours, by id, the first `most` of an incident.

    Names are resolved once each. A hub's neighbours are ranked in their incident only after each is there once."""
    known = small(graph_edits.catalog_ids(named.select("name").filter("name is not null").distinct(), nodes))
    at = cut(named.join(known, "name").select("incident", "id").distinct())
    valid = graph_edits.between(edges, nodes).filter("source <> target")
    near = valid.select(F.col("source").alias("id"), F.col("target").alias("near")).unionByName(valid.select(F.col("target").alias("id"), F.col("source").alias("near"))).distinct()
    every = at.unionByName(at.join(near, "id").select("incident", F.col("near").alias("id"))).distinct()
    told = every.join(nodes.filter(_said("description") != "").select("id", "description"), "id")
    place = F.row_number().over(Window.partitionBy("incident").orderBy("id"))
    return told.withColumn("place", place).filter(F.col("place") <= most).select("incident", "place", "id", "description")


def project_overview(nodes: DataFrame, edges: DataFrame, projects: DataFrame) -> DataFrame:
    """project, nodes, edges, architecture_nodes, dynamic_nodes, unscoped_nodes, invalid_edges of each of the projects (project),
    zero where there are none, and of all nodes and edges in the row of a null project.

    An edge belongs to the project of both its ends, and is invalid where an end is no node. nodes: (id, kind, project)."""
    count = lambda c: F.count_if(c)
    dynamic = F.col("kind").isin(*graph_edits.DYNAMIC)
    facts = (F.count(F.lit(1)).alias("nodes"), count(~dynamic).alias("architecture_nodes"), count(dynamic).alias("dynamic_nodes"))
    ends = lambda end: nodes.select(F.col("id").alias(end), F.col("project").alias(f"_{end}"), F.lit(True).alias(f"_has_{end}"))
    known = edges.join(ends("source"), "source", "left").join(ends("target"), "target", "left")
    held = known.groupBy(F.when(F.col("_source") == F.col("_target"), F.col("_source")).otherwise(F.lit("")).alias("project")).agg(F.count(F.lit(1)).alias("edges"), count(F.col("_has_source").isNull() | F.col("_has_target").isNull()).alias("invalid_edges"))
    by_project = nodes.groupBy("project").agg(*facts, count(F.coalesce(F.col("project"), F.lit("")) == "").alias("unscoped_nodes"))
    by_project, held = cut(by_project), cut(held)
    columns = ("nodes", "edges", "architecture_nodes", "dynamic_nodes", "unscoped_nodes", "invalid_edges")
    each = projects.select("project").distinct().join(by_project, "project", "left").join(held, "project", "left")
    # Two tables of one row each.
    whole = by_project.agg(*(F.sum(c).alias(c) for c in ("nodes", "architecture_nodes", "dynamic_nodes", "unscoped_nodes"))).crossJoin(held.agg(F.sum("edges").alias("edges"), F.sum("invalid_edges").alias("invalid_edges")))
    whole = whole.withColumn("project", F.lit(None).cast("string"))
    return each.unionByName(whole, allowMissingColumns=True).select("project", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
