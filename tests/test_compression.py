"""Selection of timeline rows and shrinking of payloads beside plain loops."""

import json
import random

import pytest

from opslens.operators import compression
from opslens.plans import registry

SF = "/root/testdata/sf0.001"


def plain_choice(rows, kept, capacity):
    """rows: place -> (signature, service, trace, score)."""
    last = max(rows)
    ends = {0, last}
    shown = set(kept)
    if len(shown) > capacity:
        inner = sorted(shown - ends, key=lambda p: (-rows[p][3], p))
        shown = ends | set(inner[: max(0, capacity - 2)])
    while len(shown) < min(capacity, len(rows)):
        seen = [[rows[p][i] for p in shown if rows[p][i]] for i in range(3)]

        def gain(p):
            novel = sum(g for i, g in enumerate((2.0, 1.5, 1.0)) if rows[p][i] and rows[p][i] not in seen[i])
            return rows[p][3] + novel - 2.0 * max(0, seen[0].count(rows[p][0]) - 1), -p

        shown.add(max((p for p in rows if p not in shown), key=gain))
    return shown


@pytest.mark.parametrize("kinds", [2, 5, 60])
def test_diverse(spark, kinds):
    rnd = random.Random(kinds)
    rows = {}
    for key in range(4):
        for place in range(40 * (key + 1) ** 2):
            pick = lambda n, *more: rnd.choice([*(f"{n}{i}" for i in range(kinds)), *more])
            rows[key, place] = (pick("p"), rnd.choice(["a", "b", "", None]), pick("t", "", None), float(rnd.choice([1, 2, 2, 3, 5])))
    kept = {k for k in rows if k[1] == 0 or (k[0], k[1] + 1) not in rows or rnd.random() < 0.02}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "key long, place long, signature string, service string, trace_id string, score double").repartition(5)
    must = spark.createDataFrame(sorted(kept), "key long, place long")
    for capacity in (6, 24):
        found = {(r.key, r.place) for r in compression.diverse(df, must, capacity).collect()}
        for key in range(4):
            want = plain_choice({p: tuple(x or "" for x in v[:3]) + v[3:] for (k, p), v in rows.items() if k == key}, {p for k, p in kept if k == key}, capacity)
            assert {p for k, p in found if k == key} == want
    assert compression.diverse(df.limit(0), must).count() == 0


def test_contenders_are_few(spark):
    """Rows that all differ, and rows that are all alike, leave a bounded number whatever there is."""
    for shape in ("'p' || id, 't' || id", "'p', 't' || id", "'p' || id, 't'", "'p', 't'"):
        signature, trace = shape.split(", ")
        df = spark.range(20000).selectExpr("1L as key", "id as place", f"{signature} as signature", "'s' as service", f"{trace} as trace_id", "1.0d as score")
        assert compression.contenders(df, 10).count() <= 20


def test_payload_fits(spark):
    schema = "key long, last long, events array<struct<place long, importance double, occurrences long, message string, root_cause string, details string>>, patterns array<struct<message string>>"
    rows = []
    for key, (n, length) in enumerate([(3, 20), (30, 100), (12, 900), (4, 2000), (0, 0)]):
        events = [(p + 1, float(p * 7 % 5), p % 3 + 1, "m" * length, "", "file") for p in range(n)]
        rows.append((key, n, events, [("p" * length,) for _ in range(n // 2)]))
    found = {r.key: r for r in compression.fit_budget(spark.createDataFrame(rows, schema), 3000).collect()}
    assert len(found) == 5 and len(found[0].events) == 3 and found[0].events[0].details == "file" and not found[4].events
    for key in (1, 2):
        places = [e.place for e in found[key].events]
        assert found[key].size <= 3000 and {1, rows[key][1]} <= set(places) and places == sorted(places)
    left = dict((e[0], e) for e in rows[1][2])
    size = lambda: len(json.dumps({"events": [{"place": e[0], "importance": e[1], "occurrences": e[2], "message": e[3], "root_cause": e[4], "details": e[5]} for e in left.values()], "patterns": [{"message": x[0]} for x in rows[1][3]]}, separators=(",", ":")))
    while size() > 3000 and len(left) > 4:
        del left[min((e for e in left.values() if e[0] not in (1, 30)), key=lambda e: (e[1], -e[2], -e[0]))[0]]
    assert [e.place for e in found[1].events] == sorted(left)
    assert len(found[3].events) == 4 and max(len(e.message) for e in found[3].events) <= 360 and not found[3].patterns


def test_registered_payloads(spark):
    for r in registry.QUERIES["timeline_payload"](spark, SF).collect():
        assert r.n_events >= 1 and (r.chars <= 6000 or r.n_events <= 4)
