"""Grounding of a conclusion in an architecture: identifiers in log texts, paths along real edges, members in its scope.

Nodes are (id, name, kind, runtime: map of lists of names), edges (source, target, type) by id, details (incident, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph_edits
from .lineage import cut, small

# The fields that identify a node and their order, kinds of machines, of what holds members and of what is no member.
FIELDS = ("aliases", "hostnames", "ips", "endpoints", "instance_ids", "pods")
TARGETS = ("ips", "hostnames", "endpoints", "instance_ids", "pods")
PHYSICAL, NESTED = ("Instance", "Host", "VM", "Pod"), ("Cluster", "Cache", "Database", "Middleware", "Queue", "Component")
HIERARCHY = ("System", "Layer", "Function", "UIControl", "UIFunction")
NO_MEMBER = ("Cluster", "System", "Layer", "Function", "API", "UIControl", "UIFunction")
STAGES = ("根因", "故障传播", "受影响入口")
SKIPPED, UNKNOWN, APART = "大模型路径跳过了架构中间节点，系统已按真实拓扑补全", "忽略不存在的架构节点：", "架构图中不存在 {} 到 {} 的连通路径"
LEAST_IDENTIFIER = 3
#: Characters of all identifiers together that an automaton takes; more are joined on grams.
MOST_AUTOMATON = 20_000_000
#: Steps of a search from each end.
REACH = 8


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("runtime", F.lit(name)), F.array().cast("array<string>"))


def identifiers(nodes: DataFrame) -> DataFrame:
    """id, place, identifier (trimmed), key (in lower case): names by which a node may stand in a text, of LEAST_IDENTIFIER characters or more."""
    every = F.concat(F.array("name"), *(_field(f) for f in FIELDS))
    named = nodes.select("id", F.posexplode(every).alias("place", "identifier")).select("id", "place", F.trim("identifier").alias("identifier"))
    return named.filter(F.length("identifier") >= LEAST_IDENTIFIER).withColumn("key", F.lower("identifier"))


def mentions(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """row, key: which keys (key, in lower case) each text (row, text) holds.

    Keys of at most MOST_AUTOMATON characters together become an automaton that is broadcast, and every text is gone through
    once; beyond that, keys and texts are joined on the keys' first LEAST_IDENTIFIER characters, so neither way meets all pairs."""
    keys = cut(keys.select("key").distinct())
    if (keys.agg(F.sum(F.length("key"))).first()[0] or 0) > MOST_AUTOMATON:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (LEAST_IDENTIFIER - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(LEAST_IDENTIFIER))))
        lowered = texts.select("row", F.lower("text").alias("text"))
        begun = keys.withColumn("gram", F.substring("key", 1, LEAST_IDENTIFIER))
        return lowered.withColumn("gram", F.explode(grams)).join(begun, "gram").filter(F.contains("text", F.col("key"))).select("row", "key")
    held = texts.sparkSession.sparkContext.broadcast([r.key for r in keys.toLocalIterator()])

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key in held.value:
            automaton.add_word(key, key)
        automaton.make_automaton()
        for pdf in batches:
            out = [(row, key) for row, text in zip(pdf["row"], pdf["text"]) if held.value and text for key in {k for _, k in automaton.iter(text)}]
            yield pd.DataFrame(out, columns=["row", "key"])

    kind = dict(texts.dtypes)["row"]
    return texts.select("row", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInPandas(run, f"row {kind}, key string")


def identifier_matches(details: DataFrame, nodes: DataFrame) -> DataFrame:
    """incident, id, identifier: the nodes that a text names, each by the first of its identifiers that the text holds.

    Equal texts are gone through once. Null texts hold nothing."""
    named = cut(identifiers(nodes))
    texts = cut(details.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("_n")).select(F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("_second"), "text"))
    texts = texts.withColumn("row", F.struct("row", "_second")).select(F.to_json("row").alias("row"), "text")
    found = mentions(texts, named).join(named, "key").groupBy("row", "id").agg(F.min_by("identifier", "place").alias("identifier"))
    rows = details.filter("text is not null").select("incident", F.to_json(F.struct(F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("_second"))).alias("row"))
    return rows.join(small(found), "row").select("incident", "id", "identifier").groupBy("incident", "id").agg(F.min("identifier").alias("identifier"))


def _hung(steps: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """node, parent of the nodes that one edge alone joins to the rest, round by round as those before go; and the steps that stay."""
    hung = []
    for _ in range(rounds):
        single = steps.groupBy("node").agg(F.min("next").alias("parent"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
        # Of two nodes that have only each other the lesser stays.
        both = single.select(F.col("node").alias("parent"), F.lit(True).alias("both"))
        found = cut(single.join(both, "parent", "left").filter("both is null or node > parent").select("node", "parent"))
        if not found.limit(1).count():
            break
        hung.append(found)
        steps = cut(steps.join(found.select("node"), "node", "left_anti").join(found.select(F.col("node").alias("next")), "next", "left_anti").select("node", "next"))
    return hung, steps


def pair_paths(edges: DataFrame, pairs: DataFrame, reach: int = REACH) -> DataFrame:
    """source, target, path: the shortest undirected path of each pair, the least by ids of several, of 2 * reach steps at most.

    From a node that hangs on the rest by one edge there is one way up to where ways part, so those are taken off first, and
    only what stays is searched, once for each two places where ends of pairs hang. A tree is not searched at all."""
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("next")))
    hung, steps = _hung(cut(steps.filter("node <> next").distinct()), 2 * reach)
    pairs = cut(pairs.select("source", "target").distinct())
    ends = pairs.select(F.col("source").alias("end")).unionByName(pairs.select(F.col("target").alias("end"))).distinct()
    ways = cut(ends.select("end", F.array("end").alias("way"), F.col("end").alias("top")))
    for found in hung:
        above = ways.join(found.withColumnRenamed("node", "top"), "top", "left")
        ways = cut(above.select("end", F.when(F.col("parent").isNull(), F.col("way")).otherwise(F.concat("way", F.array("parent"))).alias("way"), F.coalesce("parent", "top").alias("top")))
    up = lambda end: ways.select(F.col("end").alias(end), F.col("way").alias(f"_{end}"), F.col("top").alias(f"{end}_top"))
    pairs = cut(pairs.join(up("source"), "source").join(up("target"), "target"))
    place = lambda way: F.array_position(way, F.get(F.array_intersect("_source", "_target"), F.lit(0))).cast("int")
    near = pairs.filter("source_top = target_top").select("source", "target", F.concat(F.slice("_source", F.lit(1), place("_source")), F.reverse(F.slice("_target", F.lit(1), place("_target") - 1))).alias("path"))
    kept = steps.select("node").distinct()
    far = pairs.filter("source_top <> target_top").join(kept.select(F.col("node").alias("source_top")), "source_top", "left_semi").join(kept.select(F.col("node").alias("target_top")), "target_top", "left_semi")
    between = _searched(steps, far.select(F.col("source_top").alias("source"), F.col("target_top").alias("target")), reach)
    if between is not None:
        between = between.select(F.col("source").alias("source_top"), F.col("target").alias("target_top"), "path")
        without = lambda way: F.slice(way, F.lit(1), F.size(way) - 1)
        far = far.join(between, ["source_top", "target_top"]).select("source", "target", F.concat(without("_source"), "path", F.reverse(without("_target"))).alias("path"))
        near = near.unionByName(far)
    return near.filter(F.size("path") <= 2 * reach + 1)


def _searched(steps: DataFrame, pairs: DataFrame, reach: int) -> DataFrame | None:
    """The paths of pair_paths() by steps (node, next) in both directions; none where there are no pairs.

    The search goes from both ends, for all pairs at once, a step a side in turns, and ends where a side finds nothing new.
    Both sides keep the least path a node, read in the direction from source to target."""
    pairs = cut(pairs.distinct())
    if not pairs.limit(1).count():
        return None

    def begin(column):
        return cut(pairs.select(F.col(column).alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")))

    def grown(reached, frontier, ahead):
        longer = F.concat("path", F.array("next")) if ahead else F.concat(F.array("next"), F.col("path"))
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node"), longer.alias("path"))
        return cut(found.groupBy("seed", "node").agg(F.min("path").alias("path")).join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))

    sides = [(begin("source"), True), (begin("target"), False)]
    reached, frontier = [s for s, _ in sides], [s for s, _ in sides]
    for turn in range(2 * reach):
        side = turn % 2
        frontier[side] = grown(reached[side], frontier[side], sides[side][1])
        if not frontier[side].limit(1).count():
            break
        reached[side] = reached[side].unionByName(frontier[side])
    ahead = reached[0].select(F.col("seed").alias("source"), "node", F.col("path").alias("_ahead"))
    behind = reached[1].select(F.col("seed").alias("target"), "node", F.col("path").alias("_behind"))
    met = pairs.join(ahead, "source").join(behind, ["target", "node"]).select("source", "target", F.concat("_ahead", F.slice("_behind", 2, F.size("_behind"))).alias("path"))
    return met.groupBy("source", "target").agg(F.min(F.struct(F.size("path"), "path"))["path"].alias("path"))


def grounded_paths(proposed: DataFrame, nodes: DataFrame, edges: DataFrame, reach: int = REACH) -> DataFrame:
    """decision, path (array of node, name, stage), warnings (array) of (decision, selected, steps: array of names or ids).

    Steps are resolved to nodes, unknown ones and repeats beside each other are left out, the selected node goes first, and
    between steps that no edge joins stands the shortest way; a step that no way leads to is left out. Null and empty lists
    of steps leave the selected node alone; without that either, the path is empty."""
    given = proposed.select("decision", F.coalesce("selected", F.lit("")).alias("selected"), F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))
    asked = cut(given.select("decision", F.posexplode("steps").alias("at", "said")))
    known = cut(graph_edits.catalog_ids(asked.select(F.col("said").alias("name")).filter("name is not null").distinct(), nodes))
    asked = cut(asked.join(known.select(F.col("name").alias("said"), "id"), "said", "left"))
    along = Window.partitionBy("decision").orderBy("at")
    wanted = asked.filter("id is not null").select("decision", "at", "id").unionByName(given.filter("selected <> ''").select("decision", F.lit(-1).alias("at"), F.col("selected").alias("id")))
    wanted = wanted.withColumn("_before", F.lag("id").over(along)).filter("_before is null or _before <> id")
    # Undirected ways join what one of them joins, so a step is left out where none leads to it from the first.
    wanted = cut(wanted.withColumn("first", F.first("id").over(along)).select("decision", "at", "id", "first"))
    ways = cut(pair_paths(edges, wanted.select(F.col("first").alias("source"), F.col("id").alias("target")), reach))
    reached = wanted.join(ways.select(F.col("source").alias("first"), F.col("target").alias("id"), F.lit(True).alias("joined")), ["first", "id"], "left")
    last = F.last(F.when(F.col("joined"), F.col("id")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    reached = cut(reached.withColumn("from", last))
    hops = reached.filter("joined and from is not null").select("decision", "at", F.col("from").alias("source"), F.col("id").alias("target"))
    bridges = cut(hops.join(pair_paths(edges, hops, reach), ["source", "target"]).select("decision", "at", "path"))
    start = reached.filter("from is null").select("decision", "at", F.array("id").alias("path"))
    parts = start.unionByName(bridges.select("decision", "at", F.slice("path", 2, F.size("path")).alias("path")))
    ids = parts.groupBy("decision").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"])).alias("ids"))
    names = nodes.select("id", "name").groupBy("id").agg(F.min("name").alias("name"))
    placed = ids.select("decision", F.size("ids").alias("n"), F.posexplode("ids").alias("i", "id")).join(names, "id", "left")
    stage = F.when(F.col("i") == 0, STAGES[0]).when(F.col("i") == F.col("n") - 1, STAGES[2]).otherwise(STAGES[1])
    path = F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct(F.col("id").alias("node"), "name", stage.alias("stage")).alias("x")))), lambda x: x["x"])
    paths = placed.groupBy("decision").agg(path.alias("path"))
    show = lambda c, alias: names.select(F.col("id").alias(c), F.col("name").alias(alias))
    lost = reached.filter("joined is null").join(show("from", "a"), "from", "left").join(show("id", "b"), "id", "left")
    before, between, after = APART.split("{}")
    said = asked.filter("id is null").select("decision", F.col("at").alias("at"), F.lit(0).alias("kind"), F.concat(F.lit(UNKNOWN), F.coalesce("said", F.lit("None"))).alias("said"))
    said = said.unionByName(lost.select("decision", "at", F.lit(1).alias("kind"), F.concat(F.lit(before), "a", F.lit(between), "b", F.lit(after)).alias("said")))
    said = said.unionByName(bridges.filter(F.size("path") > 2).select("decision", "at", F.lit(1).alias("kind"), F.lit(SKIPPED).alias("said")))
    warned = said.groupBy("decision").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "said"))), lambda x: x["said"])).alias("warnings"))
    none = F.array().cast("array<struct<node:string,name:string,stage:string>>")
    out = given.select("decision").distinct().join(paths, "decision", "left").join(warned, "decision", "left")
    return out.select("decision", F.coalesce("path", none).alias("path"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def memberships(edges: DataFrame) -> DataFrame:
    """parent, member, type, in one direction."""
    down = F.col("type").isin("HAS_MEMBER", "CONTAINS")
    turned = edges.filter(down | F.col("type").isin("BELONGS_TO", "MEMBER_OF"))
    return turned.select(F.when(down, F.col("source")).otherwise(F.col("target")).alias("parent"), F.when(down, F.col("target")).otherwise(F.col("source")).alias("member"), "type").filter("parent <> '' and member <> ''").distinct()


def possible_members(selected: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """id (selected), member, kind, path: what may be meant by a cluster, found down its memberships.

    A machine is a member, and what else is named by a relation of membership, or contained, and has an address. What a
    hierarchy of pages contains is none, nor are kinds that stand for several. The search goes on below what holds members."""
    held = cut(memberships(edges))
    facts = cut(nodes.select("id", "kind", F.lower("name").alias("_name"), (sum((F.size(_field(f)) for f in TARGETS), F.lit(0)) > 0).alias("addressed")))
    parents = held.select("parent").distinct()
    below = facts.select(F.col("id").alias("member"), F.col("kind").alias("kind"), "addressed")
    above = facts.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    steps = held.join(above, "parent", "left").join(below, "member").join(parents.select(F.col("parent").alias("member"), F.lit(True).alias("holds")), "member", "left")
    steps = steps.filter(~((F.col("type") == "CONTAINS") & F.coalesce(F.col("parent_kind"), F.lit("")).isin(*HIERARCHY)))
    fits = F.col("addressed") & ~F.col("kind").isin(*NO_MEMBER)
    listed = F.col("type").isin("HAS_MEMBER", "BELONGS_TO", "MEMBER_OF") | ((F.col("type") == "CONTAINS") & ~F.coalesce(F.col("parent_kind"), F.lit("")).isin("System", "Layer"))
    concrete = F.col("kind").isin(*PHYSICAL) | (listed & fits)
    steps = cut(steps.select(F.col("parent").alias("node"), "member", "kind", concrete.alias("concrete"), (F.coalesce("holds", F.lit(False)) & (F.col("kind").isin(*NESTED) | ~concrete)).alias("onward")))
    frontier = reached = selected.select("id", F.col("id").alias("node"), F.array("id").alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("concrete"), F.lit(True).alias("onward")).distinct()
    for _ in range(depth):
        found = frontier.filter("onward").select("id", "node", "path").join(steps, "node").select("id", "member", F.concat("path", F.array("member")).alias("path"), "kind", "concrete", "onward")
        # Of several ways to a member the first counts: of the least path.
        first = found.groupBy("id", "member").agg(F.min(F.struct("path", "kind", "concrete", "onward")).alias("x")).select("id", F.col("member").alias("node"), "x.*")
        frontier = cut(first.join(reached.select("id", "node"), ["id", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
    return reached.filter("concrete").select("id", F.col("node").alias("member"), "kind", "path")


def evident_members(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """incident, selected, place, member, name, status, identifier: the possible members of what decisions (incident, selected)
    name, those first that the incident's text names (matches: incident, id, identifier), then by name."""
    found = possible_members(decisions.select(F.col("selected").alias("id")), nodes, edges).select(F.col("id").alias("selected"), "member")
    named = decisions.select("incident", "selected").distinct().join(found, "selected").join(nodes.select(F.col("id").alias("member"), "name"), "member")
    seen = named.join(matches.select("incident", F.col("id").alias("member"), "identifier"), ["incident", "member"], "left")
    place = F.row_number().over(Window.partitionBy("incident", "selected").orderBy(F.col("identifier").isNull(), F.lower("name"), "member")).cast("long")
    status = F.when(F.col("identifier").isNull(), "needs_investigation").otherwise("priority_check")
    return seen.select("incident", "selected", place.alias("place"), "member", "name", status.alias("status"), F.coalesce("identifier", F.lit("")).alias("identifier"))


def cluster_scope(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """incident, selected (as it stands), demoted: decisions (incident, selected, candidates: array of names or ids in order).

    A machine that the text doesn't name gives way to the first candidate that is a cluster it belongs to, unless it is that
    cluster's only possible member."""
    kinds = nodes.select(F.col("id").alias("selected"), "kind")
    doubted = decisions.join(kinds.filter(F.col("kind").isin(*PHYSICAL)), "selected").join(matches.select("incident", F.col("id").alias("selected")), ["incident", "selected"], "left_anti")
    asked = cut(doubted.select("incident", "selected", F.posexplode("candidates").alias("at", "said")))
    known = graph_edits.catalog_ids(asked.select(F.col("said").alias("name")).filter("name is not null").distinct(), nodes)
    named = asked.join(known.select(F.col("name").alias("said"), F.col("id").alias("parent")), "said")
    above = named.join(memberships(edges).select("parent", F.col("member").alias("selected")).distinct(), ["parent", "selected"])
    first = cut(above.groupBy("incident", "selected").agg(F.min_by("parent", "at").alias("parent")))
    members = possible_members(first.select(F.col("parent").alias("id")), nodes, edges).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("only"))
    moved = first.join(members.withColumnRenamed("id", "parent"), "parent", "left").filter("not coalesce(n = 1 and only = selected, false)").select("incident", "selected", "parent")
    out = decisions.join(moved, ["incident", "selected"], "left")
    return out.select("incident", F.coalesce("parent", "selected").alias("selected"), F.when(F.col("parent").isNotNull(), F.col("selected")).otherwise("").alias("demoted"))
