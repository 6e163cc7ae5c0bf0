"""Mined templates beside plain one-pass miners over the distinct messages in their order."""

import random

import pytest

from opslens.operators import templates

SCHEMA = "event_id long, event_s long, message string"


def _plain_tree(messages, depth=4, max_children=100, threshold=0.4):
    """A prefix tree that takes messages one after another: founder of each."""
    branches, leaves, out = {}, {}, {}
    for name, text in messages:
        tokens = text.split()
        path = (len(tokens),)
        for level in range(depth - 3):
            if level + 1 >= len(tokens):
                break
            word = tokens[level]
            if any(c.isdigit() for c in word) or word == "<*>":
                word = "<*>"
            else:
                own = branches.setdefault(path, [])
                if word not in own:
                    if len(own) < max_children - 1:
                        own.append(word)
                    else:
                        word = "<*>"
            path = (*path, word)
        held = leaves.setdefault(path, [])
        fits = [(sum(a == b for a, b in zip(t["tokens"], tokens)) / len(tokens) if tokens else 1.0, t["tokens"].count("<*>"), -i) for i, t in enumerate(held)]
        best = max(fits, default=(-1.0, 0, 0))
        if best[0] < threshold:
            held.append({"name": name, "tokens": tokens})
            best = (0.0, 0, 1 - len(held))
        home = held[-best[2]]
        home["tokens"] = [a if a == b else "<*>" for a, b in zip(home["tokens"], tokens)]
        out[text] = home
    return out


def _log(n, seed, first_words=8):
    rnd = random.Random(seed)
    words = ["open", "file", "close", "failed", "for", "user", "disk", "x1", "n77"]
    text = lambda: " ".join([rnd.choice([f"w{chr(97 + i)}" for i in range(first_words)] + ["a7"])] + [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5]))])
    return [(i, i // 3, text()) for i in range(n)] + [(n, 0, "took 12ms for 10.0.0.1"), (n + 1, 1, ""), (n + 2, 2, None)]


def _masked(spark, rows):
    from pyspark.sql import functions as F

    from opslens.functions import log_text

    events = spark.createDataFrame(rows, SCHEMA)
    named = events.select("event_id", "event_s", log_text.mask(F.coalesce("message", F.lit(""))).alias("m")).collect()
    seen = {}
    for r in sorted(named, key=lambda r: (r.event_s, r.event_id)):
        seen.setdefault(r.m, r.event_id)
    counts = {m: sum(r.m == m for r in named) for m in seen}
    return events.repartition(5), [(i, m) for m, i in seen.items()], counts


@pytest.mark.parametrize("max_children", [100, 4])
def test_tree_beside_one_pass(spark, max_children):
    events, messages, counts = _masked(spark, _log(600, 5))
    want = _plain_tree(messages, max_children=max_children)
    found, mapping = templates.mined(events, max_children=max_children)
    rows = {r.template_id: r for r in found.collect()}
    got = {r.message: (rows[r.template_id].first_id, rows[r.template_id].template) for r in mapping.collect()}
    assert got == {m: (home["name"], " ".join(home["tokens"])) for m, home in want.items()}
    totals = {}
    for m, home in want.items():
        totals[home["name"]] = totals.get(home["name"], 0) + counts[m]
    assert {r.first_id: r.n for r in rows.values()} == totals
    assert [r.template_id for r in sorted(rows.values(), key=lambda r: r.template_id)] == [f"E{i + 1:05d}" for i in range(len(rows))]
    assert templates.event_templates(events, mapping).filter("template_id is null").count() == 0


def test_similarity_alone_beside_one_pass(spark):
    events, messages, _ = _masked(spark, _log(300, 9))
    held, want = [], {}
    for name, text in messages:
        tokens = text.split()
        scores = [sum(a == b or "<*>" in (a, b) for a, b in zip(tokens, t)) / max(1, len(t)) if len(t) == len(tokens) else -1.0 for t, _ in held]
        scores = [1.0 if not tokens and not t else s for s, (t, _) in zip(scores, held)]
        at = max(range(len(held)), key=lambda i: (scores[i], -i), default=-1)
        if at < 0 or scores[at] < 0.4:
            held.append((tokens, name))
            at = len(held) - 1
        held[at] = ([a if a == b else "<*>" for a, b in zip(held[at][0], tokens)], held[at][1])
        want[text] = at
    found, mapping = templates.mined(events, tree=False)
    rows = {r.template_id: r for r in found.collect()}
    assert {r.message: rows[r.template_id].first_id for r in mapping.collect()} == {m: held[i][1] for m, i in want.items()}
    assert {(r.first_id, r.template) for r in rows.values()} == {(name, " ".join(t)) for t, name in held}


def test_chunks_come_together(spark):
    """Leaves of many chunks: templates that the whole would share are shared, whatever the chunks."""
    users = [(i, i, f"user {chr(97 + i % 26)}{chr(97 + i // 26)} logged in from somewhere") for i in range(400)] + [(1000 + i, i, f"disk {'full' if i % 2 else 'slow'} on host {chr(97 + i % 20)}") for i in range(60)]
    events = spark.createDataFrame(users, SCHEMA)
    whole = {(r.template, r.n) for r in templates.mined(events)[0].collect()}
    assert whole == {("user <*> logged in from somewhere", 400), ("disk <*> on host <*>", 60)}
    assert {(r.template, r.n) for r in templates.mined(events, chunk=15)[0].collect()} == whole
    # Two halves, mined apart, are found again in the whole: each half's template is one of the whole or more special.
    for half in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        for r in templates.mined(half)[0].collect():
            assert any(len(a.split()) == len(r.template.split()) and all(x in (y, "<*>") for x, y in zip(a.split(), r.template.split())) for a, _ in whole)


def test_of_nothing(spark):
    found, mapping = templates.mined(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and mapping.count() == 0
