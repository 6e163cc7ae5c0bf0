"""Architecture graphs as tables: nodes (id, name, kind) and edges (source, target, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules
from .lineage import cut

# Relations that a dependency search follows, and those that mean membership.
TRAVERSED = ("CALLS", "DEPENDS_ON", "USES_DB", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "CONNECTS_TO", "RUNS_ON", "HAS_MEMBER", "CONTAINS")
MEMBERSHIP, REVERSED_MEMBERSHIP = ("HAS_MEMBER", "CONTAINS"), ("BELONGS_TO", "MEMBER_OF")


def membership(edges: DataFrame) -> DataFrame:
    """parent, member: membership relations in one direction."""
    down = edges.filter(F.col("type").isin(*MEMBERSHIP)).select(F.col("source").alias("parent"), F.col("target").alias("member"))
    up = edges.filter(F.col("type").isin(*REVERSED_MEMBERSHIP)).select(F.col("target").alias("parent"), F.col("source").alias("member"))
    return down.unionByName(up).distinct()


def member_counts(edges: DataFrame) -> DataFrame:
    return membership(edges).groupBy("parent").agg(F.count(F.lit(1)).alias("n_members"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """item ('kind' or 'type'), name, n."""
    return nodes.groupBy(F.lit("kind").alias("item"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        edges.groupBy(F.lit("type").alias("item"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    )


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of any edge."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node: source, target, type, has_source, has_target."""
    known = nodes.select("id").distinct()
    out = edges.join(known.select(F.col("id").alias("_s")), F.col("source") == F.col("_s"), "left").join(known.select(F.col("id").alias("_t")), F.col("target") == F.col("_t"), "left")
    return out.select("source", "target", "type", F.col("_s").isNotNull().alias("has_source"), F.col("_t").isNotNull().alias("has_target")).filter("not (has_source and has_target)")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bounded_search(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, types=TRAVERSED) -> DataFrame:
    """seed, node, distance: every node within `depth` steps of each seed, at its least distance.

    One join a step: the frontier meets the edges, and what was reached before is left out, so cycles end. Each step's frontier
    and the edges are checkpointed, so that a step costs its own join only. The result has a row for each seed and node."""
    a, b = ("target", "source") if reverse else ("source", "target")
    steps = edges.filter(F.col("type").isin(*types)).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    steps = cut(steps)
    reached = frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("distance"))
    for distance in range(1, depth + 1):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = cut(found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(distance).cast("long")))
        reached = reached.unionByName(frontier)
    return reached


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both among `ids`."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type")


def merge_nodes(left: DataFrame, right: DataFrame, default_kind: str = "Component") -> DataFrame:
    """Nodes of both by id; the left one's fields win unless blank, or of the default kind."""
    l, r = left.select("id", F.col("name").alias("ln"), F.col("kind").alias("lk")), right.select("id", F.col("name").alias("rn"), F.col("kind").alias("rk"))  # noqa: E741
    kind = F.when(F.col("lk").isNull() | (F.col("lk") == default_kind), F.coalesce("rk", "lk")).otherwise(F.col("lk"))
    return l.join(r, "id", "full").select("id", F.coalesce(F.when(F.col("ln") != "", F.col("ln")), "rn", "ln").alias("name"), kind.alias("kind"))


#: Characters of a name that the search for containment joins on.
GRAM = 8


def resolve_entities(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id: an equal identifier (id, name, aliases) first, then an equal normalised one, then one that holds the name or
    is held by it; of several the least id. Unknown names have no id.

    Only names that no equal identifier resolves are searched for containment: the longer side is exploded into grams, of
    which one must equal the shorter side's beginning."""
    clean = text_rules.entity_name
    names = names.select("name").distinct()
    all_names = F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in nodes.columns else F.array("id", "name")
    known = nodes.select("id", F.explode(all_names).alias("known")).select("id", F.lower("known").alias("known"), clean(F.col("known")).alias("clean")).filter("known <> ''").distinct()
    asked = names.select("name", F.lower(F.trim("name")).alias("known"), clean(F.trim("name")).alias("clean"))
    exact = asked.join(known.select("id", "known"), "known").select("name", "id", F.lit(0).alias("rank"))
    near = asked.join(known.select("id", "clean"), "clean").filter("clean <> ''").select("name", "id", F.lit(1).alias("rank"))
    least = lambda found: found.groupBy("name").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
    equal = least(exact.unionByName(near))
    short = lambda rows, c: rows.withColumn("gram", F.substring(c, 1, GRAM))
    grams = f"array_distinct(flatten(transform(sequence(1, length({{0}})), i -> transform(sequence(1, {GRAM}), n -> substring({{0}}, i, n)))))"
    long = lambda rows, c: rows.withColumn("gram", F.explode(F.expr(grams.format(c))))
    left = asked.join(equal, "name", "left_anti").select("name", F.col("clean").alias("wanted")).filter("wanted <> ''")
    items = known.select("id", F.col("clean").alias("item")).filter("item <> ''").distinct()
    holds = short(left, "wanted").join(long(items, "item"), "gram").filter("contains(item, wanted)")
    held = long(left, "wanted").join(short(items, "item"), "gram").filter("contains(wanted, item)")
    best = equal.unionByName(least(holds.unionByName(held).select("name", "id", F.lit(2).alias("rank"))))
    return names.join(best, "name", "left")


def candidate_nodes(scored: DataFrame) -> DataFrame:
    """node, score, n: the best score of each node, raised a little for each further signal."""
    return scored.groupBy("node").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n")).select(
        "node", F.least(F.lit(0.98), F.col("best") + F.least(F.lit(0.09), 0.03 * (F.col("n") - 1))).alias("score"), "n"
    )


def rank_hypotheses(candidates: DataFrame, most: int = 5) -> DataFrame:
    """node, score, rank, status of the best candidates of all."""
    top = candidates.orderBy(F.col("score").desc(), "node").limit(max(1, most))
    status = F.when(F.col("score") >= 0.75, "probable").when(F.col("score") >= 0.5, "suspected").otherwise("weak")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "node")).cast("long")).withColumn("status", status)
