"""Paths where much of a graph hangs by single edges."""

import random

from opslens.operators import grounding

EDGES, PAIRS = "source string, target string, type string", "source string, target string"


def test_leaves_of_a_hub_do_not_meet_each_other(spark, monkeypatch):
    sizes, cut = [], grounding.cut
    monkeypatch.setattr(grounding, "cut", lambda df: (found := cut(df), sizes.append(found.count()))[0])
    n = 300
    edges = [("root", "hub", "CONTAINS")] + [("hub", f"s{i}", "HAS_MEMBER") for i in range(n)]
    found = grounding.pair_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(f"s{i}", f"s{(i + 1) % n}") for i in range(n)] + [("s1", "nowhere")], PAIRS))
    assert {(r.source, r.target): r.path for r in found.collect()} == {(f"s{i}", f"s{(i + 1) % n}"): [f"s{i}", "hub", f"s{(i + 1) % n}"] for i in range(n)}
    assert max(sizes) < 10 * n


def test_paths_through_trees_and_cycles_are_the_least_shortest(spark):
    rnd, reach = random.Random(3), 3
    edges = [(f"c{rnd.randrange(12)}", f"c{rnd.randrange(12)}") for _ in range(17)] + [(f"t{i}", rnd.choice([f"t{rnd.randrange(i)}" if i else "c0", f"c{rnd.randrange(12)}"])) for i in range(30)]
    edges += [("a", "b"), ("b", "a"), ("x", "x"), ("p0", "p1"), ("p1", "p2"), ("p2", "p3")] + [(f"q{i}", f"q{i + 1}") for i in range(9)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(a, b):
        level, seen = {a: [a]}, {a}
        for _ in range(2 * reach + 1):
            if b in level:
                return level[b]
            found = {}
            for p in level.values():
                for n in near.get(p[-1], ()):
                    if n not in seen and (n not in found or [*p, n] < found[n]):
                        found[n] = [*p, n]
            level = found
            seen |= set(found)
        return None

    names = sorted(near) + ["x", "nowhere"]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(500)} | {("nowhere", "nowhere"), ("x", "x"), ("a", "b"), ("b", "a"), ("p0", "p3"), ("q0", "q6"), ("q0", "q7"), ("q9", "q3")}
    found = grounding.pair_paths(spark.createDataFrame([(*e, "CALLS") for e in edges], EDGES), spark.createDataFrame(sorted(pairs), PAIRS), reach)
    assert {(r.source, r.target): r.path for r in found.collect()} == {p: w for p in pairs if (w := least(*p))}
