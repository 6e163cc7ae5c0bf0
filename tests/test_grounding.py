"""Grounding: the documented cases of paths, scopes and members, identifiers in texts, and catalogs."""

import random

import pytest

from opslens.operators import catalog, grounding

RUNTIME = "id string, name string, kind string, runtime map<string,array<string>>"
EDGES = "source string, target string, type string"


def _frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, RUNTIME), spark.createDataFrame(edges, EDGES)


GRAPH = (
    [("gateway-id", "api-gateway", "API", None), ("uaa-id", "uaa", "Service", None), ("redis-id", "Redis集群", "Cluster", None)]
    + [(f"r{i}", f"redis-{i}", "Instance", {"hostnames": [f"redis-{i}"], "endpoints": [f"redis-{i}:6379"]}) for i in (1, 2, 3)]
    + [("lone-id", "lonely", "Service", None)],
    [("gateway-id", "uaa-id", "CALLS"), ("uaa-id", "redis-id", "DEPENDS_ON")] + [("redis-id", f"r{i}", "HAS_MEMBER") for i in (1, 2)] + [("r3", "redis-id", "BELONGS_TO")],
)


def test_a_path_that_leaves_out_a_node_and_names_one_that_is_none(spark):
    proposed = [("a", "redis-id", ["redis-id", "gateway-id", "invented-id"]), ("b", "", None), ("c", "uaa-id", []), ("d", "", ["API-Gateway", "gateway-id", "lonely", "redis集群"]), ("e", "nowhere", ["uaa-id"])]
    found = grounding.grounded_paths(spark.createDataFrame(proposed, "decision string, selected string, steps array<string>"), *_frames(spark, *GRAPH))
    rows = {r.decision: r for r in found.collect()}
    assert [x.node for x in rows["a"].path] == ["redis-id", "uaa-id", "gateway-id"] and [x.stage for x in rows["a"].path] == ["根因", "故障传播", "受影响入口"]
    assert rows["a"].warnings == ["忽略不存在的架构节点：invented-id", grounding.SKIPPED]
    assert (rows["b"].path, rows["b"].warnings) == ([], []) and [x.node for x in rows["c"].path] == ["uaa-id"]
    assert [x.node for x in rows["d"].path] == ["gateway-id", "uaa-id", "redis-id"] and rows["d"].warnings[0] == "架构图中不存在 api-gateway 到 lonely 的连通路径"
    assert [x.node for x in rows["e"].path] == ["nowhere"]


def test_paths_of_many_pairs_are_the_least_shortest(spark):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", "CALLS") for _ in range(55)]
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(a, b):
        level, seen = [[a]], {a}
        while level and not any(p[-1] == b for p in level):
            found = {}
            for p in level:
                for n in sorted(near.get(p[-1], ())):
                    if n not in seen and (n not in found or [*p, n] < found[n]):
                        found[n] = [*p, n]
            seen |= set(found)
            level = sorted(found.values())
        return next((p for p in level if p[-1] == b), None)

    pairs = [(f"n{rnd.randrange(42)}", f"n{rnd.randrange(42)}") for _ in range(60)]
    found = grounding.pair_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "source string, target string"), reach=20)
    assert {(r.source, r.target): r.path for r in found.collect()} == {p: w for p in set(pairs) if (w := least(*p))}


def test_scope_of_a_conclusion(spark):
    nodes, edges = _frames(spark, *GRAPH)
    none = spark.createDataFrame([], "incident string, id string, identifier string")
    said = spark.createDataFrame([("seen", "connection refused by REDIS-2:6379"), ("unseen", "timeout"), ("empty", None)], "incident string, text string")
    matches = grounding.identifier_matches(said, nodes)
    assert [tuple(r) for r in matches.collect()] == [("seen", "r2", "redis-2")]
    asked = spark.createDataFrame([("seen", "r2", ["redis-id"]), ("unseen", "r2", ["nobody", "Redis集群"]), ("other", "r1", ["uaa"]), ("service", "uaa-id", ["redis-id"])], "incident string, selected string, candidates array<string>")
    scoped = {r.incident: (r.selected, r.demoted) for r in grounding.cluster_scope(asked, nodes, edges, matches).collect()}
    assert scoped == {"seen": ("r2", ""), "unseen": ("redis-id", "r2"), "other": ("r1", ""), "service": ("uaa-id", "")}
    # All three members, one of them by a relation the other way round; evidence comes first.
    members = grounding.evident_members(spark.createDataFrame([("seen", "redis-id"), ("unseen", "redis-id")], "incident string, selected string"), nodes, edges, matches)
    listed = sorted((r.incident, r.place, r.member, r.status) for r in members.collect())
    assert [x[2] for x in listed] == ["r2", "r1", "r3", "r1", "r2", "r3"] and listed[0][3] == "priority_check"
    assert grounding.evident_members(spark.createDataFrame([("x", "uaa-id")], "incident string, selected string"), nodes, edges, none).count() == 0
    # A cluster's only member stays.
    single = _frames(spark, GRAPH[0][:4], [("redis-id", "r1", "HAS_MEMBER")])
    alone = spark.createDataFrame([("x", "r1", ["redis-id"])], "incident string, selected string, candidates array<string>")
    assert [tuple(r) for r in grounding.cluster_scope(alone, *single, none).collect()] == [("x", "r1", "")]


@pytest.mark.parametrize("most", [20_000_000, 0])
def test_identifiers_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(grounding, "MOST_AUTOMATON", most)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abAB:-") for _ in range(n))
    nodes = [(f"n{i}", word(rnd.randrange(1, 6)), "Host", {"aliases": [word(3), " " + word(4)], "ips": [word(2)]} if i % 2 else None) for i in range(40)]
    texts = [(i, word(rnd.randrange(0, 12)) or None) for i in range(150)]
    want = {}
    for i, text in texts:
        for node, name, _, runtime in nodes:
            named = [name, *((runtime or {}).get("aliases") or []), *((runtime or {}).get("ips") or [])]
            hit = next((x.strip() for x in named if len(x.strip()) >= 3 and x.strip().lower() in (text or "").lower()), None)
            if hit:
                want[i, node] = hit
    found = grounding.identifier_matches(spark.createDataFrame(texts, "incident long, text string"), spark.createDataFrame(nodes, RUNTIME))
    assert {(r.incident, r.id): r.identifier for r in found.collect()} == want


def test_catalogs(spark):
    nodes = spark.createDataFrame([("1", "a", "Service"), ("2", "b", "Odd kind!"), ("3", "c", None), ("4", 'say "x"', "Host")], "id string, name string, kind string")
    edges = spark.createDataFrame([("1", "2", "CALLS"), ("2", "3", "NEAR BY"), ("3", "4", None)], EDGES)
    rows = catalog.encoded(nodes, edges)
    assert {r.item for r in rows.filter("part = 't'").collect()} == {'["SV","Service"]', '["ODDKIND","Odd kind!"]', '["CP","Component"]', '["HO","Host"]'}
    back = catalog.decoded(rows)
    assert {tuple(r) for r in back[0].collect()} == {("1", "a", "Service"), ("2", "b", "Odd kind!"), ("3", "c", "Component"), ("4", 'say "x"', "Host")}
    assert {tuple(r) for r in back[1].collect()} == {("1", "2", "CALLS"), ("2", "3", "NEAR BY"), ("3", "4", "CALLS")}
    told = lambda n, e: catalog.fingerprint(n, e).first().fingerprint
    first = told(nodes, edges)
    assert first == told(nodes.repartition(3).orderBy("name"), edges.orderBy("target", ascending=False)) and first.startswith("sha256:") and len(first) == 23
    assert len({first, told(nodes, edges.filter("source <> '3'")), told(nodes, edges.unionByName(edges)), told(nodes.limit(0), edges)}) == 4
    assert told(nodes.limit(0), edges.limit(0))
