"""The last turn of the n-gram join, on near copies that meet in many tiles."""

import collections

import brute
import numpy as np
import pytest

from opslens.llm import ngram_join
from opslens.llm.common import Scratch


def _near_copies(seed: int, groups: int, each: int) -> list[tuple]:
    """Copies of a few texts with so many edits that most pairs just don't link at 5 words and 80 percent."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(each):
            words = list(base)
            for i in rng.choice(200, int(rng.integers(2, 8)), replace=False):
                words[i] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_each_pair_of_a_group_is_compared_once(spark):
    rows = _near_copies(1, 2, 60)
    sets = {d: ngram_join.shingles(t, 5) for d, t in rows}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for tile in ngram_join.tiles(s, 80).view(np.int64).tolist():
            where[tile].append(d)
    where = {t: x for t, x in where.items() if len(x) > 1}
    weight = collections.Counter()
    for x in where.values():
        weight.update({d: len(x) for d in x})
    met = collections.Counter((a, b) for x in where.values() for a in x for b in x if a < b)
    assert sum(met.values()) > 20 * len(met)  # pairs meet again and again

    store = Scratch(spark, "test")
    members = spark.createDataFrame([(t, d, weight[d]) for t, x in where.items() for d in x], "tile long, class long, weight long")
    roots = members.selectExpr("class as node", "class as root").limit(0)
    opened = ngram_join.open_tiles(members, roots, 0, store)
    known = store.save(ngram_join.signed_sets(spark.createDataFrame(rows, "key long, text string"), 5), "known")
    held, mixed = ngram_join.groups(opened, store)
    found = [tuple(r) for r in ngram_join.group_pairs(held, known, 80).collect()]
    assert len(found) == len(set(found)) > 0 and held.count() > 100 and mixed.count() < opened.count() / 10
    found += [tuple(r) for r in ngram_join.tile_pairs(mixed, known, 80).collect()]
    assert len(found) == len(set(found))
    links = {(a, b) for a in sets for b in sets if a < b and 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert links and links <= set(found)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_last_turn_alone(spark, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "PIVOTS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = _near_copies(2, 3, 40)
    rows += [(len(rows) + i, " ".join((rows[i][1].split() + rows[i + 40][1].split())[i : 250 + i])) for i in range(40)]  # of two groups
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, words, percent).collect())
    assert found == sorted(brute.ngram_join(rows, words, percent))
