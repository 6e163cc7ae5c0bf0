"""Edits and checks of architecture graphs: nodes (id, name, kind, project, source_file, observed) and edges (source, target, type).

An edit takes whole tables and returns the new ones; the caller writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

# Kinds that only analyses make, relations of dependency and membership, kinds that contain and that don't count as contained.
DYNAMIC = ("Incident", "Trace", "LogEvent", "Exception", "Window", "Metric", "RCAHypothesis", "UnresolvedDependency")
DEPENDENCY = ("CALLS", "DEPENDS_ON", "USES_DB", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "CONNECTS_TO", "RUNS_ON")
CONTAINERS = ("Cluster", "Cache", "Database", "Middleware", "Queue", "Component")
STRUCTURAL = ("System", "Layer", "Function", "API")
DEFAULT_KIND, DEFAULT_TYPE = "Component", "CALLS"
_EDGE = ["source", "target", "type"]


def _ids(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(F.col("id").alias(name)).distinct()


def static_part(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that no analysis made, and the edges between them."""
    kept = nodes.filter(~F.col("kind").isin(*DYNAMIC) & ~F.coalesce("observed", F.lit(False)))
    return kept, between(edges, kept)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes."""
    return edges.join(_ids(nodes, "source"), "source", "left_semi").join(_ids(nodes, "target"), "target", "left_semi").select(*edges.columns)


def project_part(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """A project's nodes, by their column or the beginning of their name, and the edges between them."""
    kept = nodes.filter((F.col("project") == project) | F.col("name").startswith(f"project::{project}::"))
    return kept, between(edges, kept)


def traversable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that a dependency search follows: dependencies, members, and what containers contain unless it is structure."""
    kinds = lambda end: nodes.select(F.col("id").alias(end), F.col("kind").alias(f"_{end}"))
    known = edges.join(kinds("source"), "source", "left").join(kinds("target"), "target", "left")
    contained = (F.col("type") == "CONTAINS") & F.col("_source").isin(*CONTAINERS) & F.col("_target").isNotNull() & ~F.col("_target").isin(*STRUCTURAL)
    return known.filter(F.col("type").isin(*DEPENDENCY, "HAS_MEMBER") | F.coalesce(contained, F.lit(False))).select(*edges.columns)


def written(edges: DataFrame, co_occurrence: bool = False, temporal: bool = True) -> DataFrame:
    """The edges that are stored: co-occurrence and time order only where asked for."""
    left_out = [t for t, on in (("CO_OCCURS_WITH", co_occurrence), ("TEMPORALLY_PRECEDES", temporal)) if not on]
    return edges.filter(~F.col("type").isin(*left_out)) if left_out else edges


def faceted(nodes: DataFrame, project: str | None = None, kind: str | None = None, query: str | None = None) -> DataFrame:
    """The nodes of a project and kind whose fields hold a text in any case."""
    for name, value in (("project", project), ("kind", kind)):
        nodes = nodes.filter(F.col(name) == value) if value else nodes
    said = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("id", "name", "kind", "project", "source_file"))))
    return nodes.filter(F.contains(said, F.lit(query.lower()))) if query else nodes


def is_aggregate(kind: Column, name: Column) -> Column:
    """Whether a node stands for several instances."""
    return (kind == "Cluster") | (kind.isin("Cache", "Database", "Middleware", "Queue", "Component", "Service") & F.lower(name).rlike("cluster|集群|节点组|实例组|组件组"))


def safe_kind(kind: Column, known: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*known), kind).otherwise(F.lit(DEFAULT_KIND))


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored nodes, with those of `new` in place of equal names; of new ones with one name the greatest id counts."""
    named = [F.max_by(F.struct(*new.columns), "id").alias("x")]
    single = new.groupBy("name").agg(*named).select("x.*").select(*stored.columns)
    return stored.join(single.select("name"), "name", "left_anti").select(*stored.columns).unionByName(single)


def insert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored edges and those of `new` that they lack, each once, without blank ends and loops."""
    fresh = new.filter("source <> '' and target <> '' and source <> target").select(*_EDGE).distinct()
    return stored.unionByName(fresh.join(stored, _EDGE, "left_anti").select(*stored.columns))


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, as nodes of the default kind."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).filter("id <> ''").distinct()
    fields = {"name": F.col("id"), "kind": F.lit(DEFAULT_KIND)}
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    return lost.select("id", *(fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in nodes.dtypes if c != "id"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes and without the edges at them."""
    kept = nodes.join(_ids(ids, "id"), "id", "left_anti").select(*nodes.columns)
    return kept, edges.join(_ids(ids, "source"), "source", "left_anti").join(_ids(ids, "target"), "target", "left_anti").select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*_EDGE), _EDGE, "left_anti").select(*edges.columns)


def replace_edges(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The edges with old ones replaced by new ones, as one table."""
    return insert_edges(delete_edges(edges, old), new)


def rename(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges with the ends that names (old, new) rename; loops that this makes go, and equal edges count once."""
    ends = lambda end: names.select(F.col("old").alias(end), F.col("new").alias(f"_{end}"))
    moved = edges.join(ends("source"), "source", "left").join(ends("target"), "target", "left")
    moved = moved.select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), "type")
    return moved.filter("source <> target").distinct()


def delete_batch(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a batch's dynamic nodes, and without the traces and exceptions that have no edge afterwards."""
    gone = nodes.filter(F.col("kind").isin(*DYNAMIC) & F.contains("name", F.lit(f":{prefix}:")))
    left, edges = delete_nodes(nodes, edges, gone)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    bare = left.filter(F.col("kind").isin("Trace", "Exception")).join(ends, "id", "left_anti")
    return left.join(bare.select("id"), "id", "left_anti").select(*nodes.columns), edges


def quality(nodes: DataFrame, edges: DataFrame, projects: DataFrame) -> DataFrame:
    """check, n: orphans, dangling edges, duplicate edges, nodes without project, edges across projects, unknown projects."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_linked", F.lit(True))
    owner = lambda end: nodes.select(F.col("id").alias(end), F.col("project").alias(f"_{end}"), F.lit(True).alias(f"_has_{end}"))
    known = edges.join(owner("source"), "source", "left").join(owner("target"), "target", "left")
    placed = nodes.join(ends, "id", "left").join(projects.select("project").distinct().withColumn("_listed", F.lit(True)), "project", "left")
    named = F.coalesce("project", F.lit("")) != ""
    count = lambda condition, name: F.count_if(condition).alias(name)
    # One pass for each table and join; three tables of one row each meet.
    of_nodes = placed.agg(count(F.col("_linked").isNull(), "orphan_nodes"), count(~named, "unscoped_nodes"), count(named & F.col("_listed").isNull(), "unknown_projects"))
    of_edges = known.agg(count(F.col("_has_source").isNull() | F.col("_has_target").isNull(), "dangling_edges"), count(F.col("_source") != F.col("_target"), "cross_project_edges"))
    of_copies = edges.groupBy(*_EDGE).count().agg(count(F.col("count") > 1, "duplicate_edges"))
    every = of_nodes.join(F.broadcast(of_edges)).join(F.broadcast(of_copies))
    return every.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in every.columns))).alias("x")).select("x.*")


def orphan_diagnosis(orphans: DataFrame) -> DataFrame:
    """id, cause, risk of deletion: by the first rule that holds."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    cause = F.when(empty("project"), "unscoped").when(F.col("kind").isin(*DYNAMIC), "dynamic").when(F.lower("source_file") == "manual", "manual").when(~empty("source_file"), "imported").otherwise("leftover")
    risk = F.when(cause.isin("unscoped", "leftover"), "high").when(cause == "dynamic", "low").otherwise("medium")
    return orphans.select("id", cause.alias("cause"), risk.alias("risk"))


def catalog(nodes: DataFrame) -> DataFrame:
    """alias, id: lowered ids and names, each with the least id that has it."""
    return nodes.select("id", F.explode(F.array("id", "name")).alias("alias")).select("id", F.lower(F.trim("alias")).alias("alias")).filter("alias <> ''").groupBy("alias").agg(F.min("id").alias("id"))


def catalog_ids(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id: the node whose id is the name, else the one that has it as an alias in any case."""
    exact = nodes.select(F.col("id").alias("name"), F.col("id").alias("_exact"))
    alias = catalog(nodes).select(F.col("alias").alias("_alias"), F.col("id").alias("_found"))
    found = asked.select("name", F.lower(F.trim("name")).alias("_alias")).distinct().join(exact, "name", "left").join(alias, "_alias", "left")
    return found.select("name", F.coalesce("_exact", "_found").alias("id"))


def members(pairs: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """seed, node, distance of all that memberships (parent, member) lead down to, step by step from a checkpointed frontier."""
    pairs = cut(pairs)
    reached = frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("distance"))
    for distance in range(1, depth + 1):
        found = frontier.join(pairs, frontier["node"] == pairs["parent"]).select("seed", F.col("member").alias("node")).distinct()
        frontier = cut(found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(distance).cast("long")))
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
    return reached


def single_members(pairs: DataFrame) -> DataFrame:
    """parent, member of the parents that have one member."""
    return pairs.groupBy("parent").agg(F.count_distinct("member").alias("n"), F.min("member").alias("member")).filter("n = 1").drop("n")


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """seed, node, path: the shortest path to every node within `depth` steps, the least one by names of several.

    A step joins the last frontier, which is checkpointed, to the edges and keeps one path a node; nodes that have one are left out."""
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    if undirected:
        steps = steps.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("next")))
    steps = cut(steps.distinct())
    reached = frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"))
    for _ in range(depth):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        found = found.groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = cut(found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
    return reached


def causal_steps(paths: DataFrame) -> DataFrame:
    """seed, node, step, cause, effect: paths from consumer to dependency, read from the cause on."""
    turned = paths.select("seed", "node", F.reverse("path").alias("path")).filter(F.size("path") > 1)
    return turned.select("seed", "node", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("cause"), F.slice("path", 2, F.size("path")).alias("effect"))).alias("step", "x")).select("seed", "node", F.col("step").cast("long").alias("step"), "x.cause", "x.effect")


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, payload: a JSON row of each node and edge."""
    return nodes.select(F.lit("node").alias("item"), F.to_json(F.struct(*sorted(nodes.columns))).alias("payload")).unionByName(edges.select(F.lit("edge").alias("item"), F.to_json(F.struct(*_EDGE)).alias("payload")))


def imported(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from JSON rows, with default kind and type where they have none."""
    node = F.from_json("payload", "id string, name string, kind string, project string, source_file string, observed boolean")
    nodes = payloads.filter("item = 'node'").select(node.alias("x")).select("x.*").filter("id <> ''")
    nodes = nodes.withColumns({"name": F.coalesce("name", "id"), "kind": F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit(DEFAULT_KIND)), "source_file": F.coalesce("source_file", F.lit("manual_import"))})
    edges = payloads.filter("item = 'edge'").select(F.from_json("payload", "source string, target string, type string").alias("x")).select("x.*")
    return nodes, edges.withColumn("type", F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit(DEFAULT_TYPE)))

