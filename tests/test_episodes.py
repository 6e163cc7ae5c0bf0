"""Order-dependent operators beside plain loops over all events."""

import random

from opslens.operators import episodes

SCHEMA = "event_id long, event_s long, trace_id string, service string, downstream string, family string, exception_key string, is_wrapper boolean, is_atomic boolean"


def plain_episodes(rows):
    held = []
    out = {}
    for e, t, trace, service, target, family, key, wrapper, atomic in sorted(rows, key=lambda r: (r[1], r[0])):
        best, chosen = -1, None
        for c in reversed(held):
            gap = t - c["last"]
            home = not service or not c["s"] or service in c["s"]
            if trace and trace in c["t"] and gap <= 600:
                score = 100
            elif target and (target in c["s"] or target in c["d"]) and gap <= 45:
                score = 95
            elif gap <= 20 and (wrapper or c["a"] or atomic):
                score = 85
            elif key in c["k"] and home and gap <= 480:
                score = 90
            elif family in c["f"] and home and gap <= 300:
                score = 80
            else:
                score = -1
            if score > best:
                best, chosen = score, c
        if best < 0:
            chosen = {"id": e, "s": set(), "t": set(), "d": set(), "f": set(), "k": set(), "a": False}
            held.append(chosen)
        chosen["last"], chosen["a"] = t, chosen["a"] or atomic
        for name, value in (("s", service), ("t", trace), ("d", target), ("f", family), ("k", key)):
            if value:
                chosen[name].add(value)
        out[e] = chosen["id"]
    return out


def test_fault_episodes(spark):
    rnd = random.Random(3)
    at, rows = 0, []
    for i in range(1500):
        at += rnd.choice([0, 5, 30, 100, 400, 700, 1500])
        pick = lambda n, *more: rnd.choice([*(f"{n}{j}" for j in range(4)), *more])
        rows.append((i, at, rnd.choice([f"t{i // 3}", "", None]), pick("svc", ""), pick("svc", "", "", None), pick("f"), pick("k"), rnd.random() < 0.1, rnd.random() < 0.1))
    found = episodes.fault_episodes(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {r.event_id: r.episode for r in found.collect()} == plain_episodes(rows)
    assert episodes.fault_episodes(spark.createDataFrame([], SCHEMA)).count() == 0
