"""Compression of incident timelines: rows (key, place, level, service, signature, message, score), places counted without gaps from 0.

What must stay is told by joins on (key, place), so that a long timeline is never one task's work; where only the best few
of a key count, tasks reduce them by hash first (see best())."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_text, text_rules
from .lineage import cut, small

MAX_EVENTS, CONTEXT, MAX_PATTERNS = 48, 2, 12
ANCHOR_LEVELS, ANCHOR_SCORE, REPEATED_SCORE = ("FATAL", "CRITICAL", "ERROR"), 8.0, 7.0
#: Parts that the rows of a key are dealt into before its best ones are chosen.
SPREAD = 64


def numbered(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The rows, checkpointed, with `place` in their key's order from 0.

    Rows are dealt out by ranges of (key, order), so that a long key spans several tasks; of each key only a count a range is summed up."""
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    parts = ranged.groupBy(key, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = small(parts.withColumn("_before", before).drop("_n"))
    return ranged.join(parts, [key, "_part"]).withColumn("place", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")


def best(rows: DataFrame, keys: list[str], order: list, most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key with their rank. Each of SPREAD parts of a key keeps its own first ones, then these meet."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))
    few = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_rank") <= most)
    few = few.drop("_part", "_rank")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= most)


def pattern_members(rows: DataFrame) -> DataFrame:
    """key, signature, n, first_place, last_place, best_score."""
    return rows.groupBy("key", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.max("score").alias("best_score"))


def anchors(rows: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """key, place of the strongest errors and high scores: max_events / 2 of a key, 4 at least."""
    strong = rows.filter(F.upper("level").isin(*ANCHOR_LEVELS) | (F.col("score") >= ANCHOR_SCORE)).select("key", "place", "score")
    return best(strong, ["key"], [F.col("score").desc(), "place"], max(4, max_events // 2)).select("key", "place")


def mandatory(rows: DataFrame, max_events: int = MAX_EVENTS, radius: int = CONTEXT) -> DataFrame:
    """key, place, reasons of the rows that a compressed timeline keeps: its ends, first and last ones of strong repeated
    patterns, anchors, and what stands within the radius of an anchor."""
    ends = rows.groupBy("key").agg(F.min("place").alias("timeline_start"), F.max("place").alias("timeline_end"))
    named = lambda df, columns: df.select("key", F.explode(F.array(*(F.struct(F.col(c).alias("place"), F.lit(r).alias("reason")) for c, r in columns))).alias("x")).select("key", "x.*")
    strong = pattern_members(rows).filter(f"n > 1 and best_score >= {REPEATED_SCORE}")
    found = anchors(rows, max_events)
    around = F.array(*(F.struct((F.col("place") + d).alias("place"), F.lit(f"context_{'after' if d > 0 else 'before'}_{abs(d)}" if d else "failure_anchor").alias("reason")) for d in range(-radius, radius + 1)))
    near = found.select("key", F.explode(around).alias("x")).select("key", "x.*")
    near = near.join(ends, "key").filter("place between timeline_start and timeline_end").select("key", "place", "reason")
    every = named(ends, [(c, c) for c in ("timeline_start", "timeline_end")]).unionByName(named(strong, [("first_place", "pattern_first"), ("last_place", "pattern_last")])).unionByName(near)
    return every.groupBy("key", "place").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def pattern_summaries(rows: DataFrame, most: int = MAX_PATTERNS) -> DataFrame:
    """key, signature, n, first_place, last_place, level and place of the representative, priority of repeated patterns."""
    weight = log_text.level_weight(F.col("level"))
    signals = sum((F.when(F.col("message").rlike(f"(?i){p}"), 1).otherwise(0) for p, _ in log_text.SIGNALS), F.lit(0))
    shown = F.max_by(F.struct("level", "place", weight.alias("severity")), F.struct(weight, signals, -F.col("place"))).alias("shown")
    found = rows.groupBy("key", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), shown).filter("n > 1")
    found = found.select("key", "signature", "n", "first_place", "last_place", F.col("shown.level").alias("level"), F.col("shown.place").alias("representative"), F.round(2.0 * F.log2(F.col("n") + 1) + F.col("shown.severity"), 6).alias("priority"))
    return best(found, ["key"], [F.col("priority").desc(), "first_place"], most)


def pattern_tops(rows: DataFrame, kept: DataFrame, most: int = 2) -> DataFrame:
    """key, place, signature, rank: of each pattern the rows that must stay first, then the best ones; rows that must stay all stay."""
    marked = rows.join(kept.select("key", "place", F.lit(0).alias("_free")), ["key", "place"], "left").withColumn("_free", F.coalesce("_free", F.lit(1)))
    ranked = best(marked.select("key", "signature", "place", "score", "_free"), ["key", "signature"], ["_free", F.col("score").desc(), "place"], most)
    must = kept.join(ranked.select("key", "place"), ["key", "place"], "left_anti").join(rows.select("key", "place", "signature"), ["key", "place"])
    return ranked.select("key", "place", "signature", "rank").unionByName(must.select("key", "place", "signature", F.lit(None).cast("long").alias("rank")))


def limited(rows: DataFrame, essential: DataFrame, limit: int) -> DataFrame:
    """key, place of at most `limit` rows of each key: essential ones, and evenly spaced ones of the rest.

    Ranks come from counts by range of places, then within a range, so no key is ordered as a whole."""
    marked = rows.select("key", "place").join(essential.select("key", "place", F.lit(True).alias("_must")).distinct(), ["key", "place"], "left").withColumn("_must", F.coalesce("_must", F.lit(False)))
    marked = marked.withColumn("_range", F.floor(F.col("place") / 1000))
    sizes = marked.groupBy("key", "_must", "_range").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("key", "_must").orderBy("_range")
    sizes = sizes.select("key", "_must", "_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("key", "_must", "_range").orderBy("place")) - 1
    ranked = marked.join(sizes, ["key", "_must", "_range"]).withColumn("_rank", F.col("_before") + within)
    totals = marked.groupBy("key").agg(F.sum(F.col("_must").cast("long")).alias("_musts"), F.sum((~F.col("_must")).cast("long")).alias("_rest"))
    ranked = ranked.join(totals, "key")
    slots = F.least(F.greatest(F.lit(limit) - F.col("_musts"), F.lit(0)), F.col("_rest"))
    steps, last = slots - 1, F.col("_rest") - 1
    i = F.ceil(F.col("_rank") * steps / last)
    even = F.when(slots <= 0, False).when(slots == F.col("_rest"), True).when(slots == 1, F.col("_rank") == 0).otherwise(F.floor(i * last / steps) == F.col("_rank"))
    whole = F.col("_musts") + F.col("_rest") <= limit
    return ranked.filter(whole | F.when(F.col("_must"), F.col("_rank") < limit).otherwise(even)).select("key", "place")


#: What a pattern, a service and a trace that nothing shown has yet add to a row's score, and what each repeat of a pattern takes.
NEW_PATTERN, NEW_SERVICE, NEW_TRACE, REPEAT = 2.0, 1.5, 1.0, 2.0


def contenders(rows: DataFrame, capacity: int) -> DataFrame:
    """The rows (key, place, service, signature, trace_id, score) that a choice of `capacity` rows by score and novelty can reach.

    What is left out can't be chosen: fewer than `capacity` patterns and traces are shown while a row is chosen, so among
    that many better rows of the same service that differ in one of the two alone, or twice as many that differ in both,
    one has all the novelty that a row can have. What stays is bounded for each service of a key, whatever the rows."""
    order = [F.col("score").desc(), "place"]
    group = ["key", "service", "signature", "trace_id"]
    better = lambda: F.struct("score", -F.col("place"))
    first = lambda df, keys, *columns: df.groupBy(*keys).agg(F.max_by(F.struct(*columns, "score", "place"), better()).alias("x")).select(*keys, "x.*")
    heads = first(rows, group)
    few = best(heads.filter("trace_id <> ''"), group[:3], order, capacity).drop("rank").unionByName(heads.filter("trace_id = ''"))
    few = best(few, ["key", "service", "trace_id"], order, capacity).drop("rank")
    apart = first(first(few.filter("trace_id <> ''"), ["key", "service", "trace_id"], "signature"), ["key", "service", "signature"])
    least = best(apart, ["key", "service"], order, 2 * capacity).filter(F.col("rank") == 2 * capacity).select("key", "service", F.struct("score", (-F.col("place")).alias("place")).alias("_least"))
    near = best(rows.join(few.select(*group), group, "left_semi"), group, order, capacity).drop("rank")
    near = near.join(least, ["key", "service"], "left")
    return near.filter(F.col("_least").isNull() | (F.struct("score", (-F.col("place")).alias("place")) >= F.col("_least"))).select(*rows.columns)


def _chooser(capacity: int):
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        must = rows["must"].to_numpy()
        shown, free = list(np.flatnonzero(must)), ~must
        value = rows["score"].to_numpy(float)
        codes = {c: pd.factorize(rows[c])[0] for c in ("signature", "service", "trace_id")}
        counts = {c: np.bincount(codes[c][must], minlength=len(rows)) for c in codes}
        novel = [(c, gain, (rows[c] != "").to_numpy() | (c == "signature")) for c, gain in (("signature", NEW_PATTERN), ("service", NEW_SERVICE), ("trace_id", NEW_TRACE))]
        while len(shown) < capacity and free.any():
            gain = sum(np.where(named & (counts[c][codes[c]] == 0), g, 0.0) for c, g, named in novel)
            gain = value + gain - np.maximum(counts["signature"][codes["signature"]] - 1, 0) * REPEAT
            at = int(np.argmax(np.where(free, gain, -np.inf)))
            shown.append(at)
            free[at] = False
            for c in codes:
                counts[c][codes[c][at]] += 1
        return rows.loc[sorted(shown), ["key", "place"]]

    return choose


def diverse(rows: DataFrame, kept: DataFrame, capacity: int = MAX_EVENTS) -> DataFrame:
    """key, place of at most `capacity` rows of each key: those of `kept` (both ends, then the best, if there are too many),
    then one by one the row with the best score and novelty among what is left; of equals the first.

    Null services and traces count as empty, which is never new. A task sees only what contenders() leaves of a key."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("signature", "service", "trace_id")]
    rows = rows.select("key", "place", "score", *named)
    kept = kept.select("key", "place").distinct()
    ends = rows.groupBy("key").agg(F.max("place").alias("_last"))
    must = rows.join(kept, ["key", "place"], "left_semi").join(ends, "key").withColumn("_inner", (~F.col("place").isin(0) & (F.col("place") != F.col("_last"))).cast("int"))
    must = best(must, ["key"], ["_inner", F.col("score").desc(), "place"], capacity).select(*rows.columns, F.lit(True).alias("must"))
    free = contenders(rows.join(kept, ["key", "place"], "left_anti"), capacity).withColumn("must", F.lit(False))
    names = rows.schema
    return must.unionByName(free).groupBy("key").applyInPandas(_chooser(capacity), f"key {names['key'].dataType.simpleString()}, place {names['place'].dataType.simpleString()}")


def fit_budget(payloads: DataFrame, max_chars: int) -> DataFrame:
    """The payloads with `events` and `patterns` made to fit max_chars as JSON where they can, and their `size`.

    In this order, each step only while the size is over: events but the first and last of the timeline go by least
    importance, most occurrences and last place, down to four; patterns go from the end; texts are cut to 360, 300, 240,
    180 and 120 characters; details go, and patterns after the third. A payload may still be larger then. `events` are
    structs with place, importance, occurrences, message, root_cause, details; `patterns` with message; `last` is the
    place of the last row of the timeline. A payload is bounded by what was selected for it."""
    size = lambda: F.length(F.to_json(F.struct("events", "patterns")))
    chars = lambda x: F.length(F.to_json(x)) + 1
    over = lambda: F.col("_size") > max_chars
    cut = lambda floor: lambda s, x: F.when((s["size"] > max_chars) & (s["left"] > floor), F.struct((s["size"] - chars(x)).alias("size"), (s["left"] - 1).alias("left"))).otherwise(s)
    start = lambda c: F.struct(F.col("_size").alias("size"), F.size(c).alias("left"))
    inner = lambda e: (e["place"] != 1) & (e["place"] != F.col("last"))
    order = F.transform(F.filter("events", inner), lambda e: F.struct(e["importance"].alias("a"), (-e["occurrences"]).alias("b"), (-e["place"]).alias("c"), e.alias("e")))
    found = payloads.withColumn("_size", size()).withColumn("_first", F.transform(F.array_sort(order), lambda x: x["e"]))
    found = found.withColumn("_left", F.aggregate("_first", start("events"), cut(4))["left"])
    gone = F.transform(F.slice("_first", 1, F.size("events") - F.col("_left")), lambda e: e["place"])
    found = found.withColumn("_gone", gone).withColumn("events", F.filter("events", lambda e: ~F.array_contains("_gone", e["place"]))).withColumn("_size", size())
    found = found.withColumn("_left", F.aggregate(F.reverse("patterns"), start("patterns"), cut(0))["left"]).withColumn("patterns", F.slice("patterns", 1, F.col("_left"))).withColumn("_size", size())
    for most in (360, 300, 240, 180, 120):
        events = F.transform("events", lambda e: e.withField("message", text_rules.truncate(e["message"], most)).withField("root_cause", text_rules.truncate(e["root_cause"], min(most, 260))))
        patterns = F.transform("patterns", lambda p: p.withField("message", text_rules.truncate(p["message"], min(most, 240))))
        found = found.withColumns({"events": F.when(over(), events).otherwise(F.col("events")), "patterns": F.when(over(), patterns).otherwise(F.col("patterns"))}).withColumn("_size", size())
    bare = F.transform("events", lambda e: e.withField("details", F.lit(None).cast("string")))
    found = found.withColumns({"events": F.when(over(), bare).otherwise(F.col("events")), "patterns": F.when(over(), F.slice("patterns", 1, 3)).otherwise(F.col("patterns"))})
    return found.withColumn("size", size()).drop("_size", "_first", "_left", "_gone")


# The roles of events that stand near a root, and the words of a strong signal.
ROOT_ROLES = ("root", "root_candidate", "root-candidate", "upstream_effect", "upstream-effect")
STRONG = (
    "connection refused|connection reset|broken pipe|no route to host|outofmemory|oom|java heap space|metaspace|deadlock|lock wait timeout|"
    "timeout|timed out|deadline exceeded|disk full|no space left|unavailable|authentication failed|access denied|panic|fatal"
)


def relevance(rows: DataFrame) -> DataFrame:
    """The rows with `relevance` (long) and `mandatory`, of events beside what their incident says of its root.

    Events: event_id, level, at, role, message, root_cause, exception_class; incident: root_at, root_exception,
    candidate_ids, candidate_texts (arrays). Null counts as empty, and empty matches nothing."""
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    said = F.concat_ws(" ", text("root_cause"), text("message"), text("exception_class"), text("role"))
    level = F.upper(text("level"))
    ids, texts = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("candidate_ids", "candidate_texts"))
    same_time = (text("at") != "") & (text("at") == text("root_at"))
    candidate = (text("event_id") != "") & F.array_contains(ids, F.trim(F.col("event_id").cast("string")))
    rooted = (text("root_exception") != "") & said.contains(text("root_exception"))
    named = F.exists(texts, lambda t: (F.trim(t) != "") & said.contains(F.lower(F.trim(t))))
    points = (
        (same_time, 140), (candidate, 140), (rooted, 100), (text("role").isin(*ROOT_ROLES), 85), (said.rlike(STRONG), 75), (named, 65),
        (text("root_cause") != "", 35), (text("exception_class") != "", 30),
    )
    score = F.when(level.isin("FATAL", "CRITICAL"), 120).when(level == "ERROR", 90).when(level.isin("WARN", "WARNING"), 28).otherwise(0)
    for holds, n in points:
        score = score + F.when(holds, n).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({"relevance": score.cast("long"), "mandatory": flag(same_time) | flag(candidate) | flag(rooted)})


#: Relevance from which an event's neighbours are shown with it.
AROUND = 50


def relevant_context(rows: DataFrame, radius: int = CONTEXT) -> DataFrame:
    """key, place of the rows (key, place, relevance) that are an anchor, or stand within the radius of one that is relevant
    enough; anchors are the rows with a relevance above 0. Neighbours are joined by place, so no timeline is one task's work."""
    anchors = rows.filter("relevance > 0").select("key", "place", "relevance")
    offsets = F.when(F.col("relevance") >= AROUND, F.sequence(F.lit(-radius), F.lit(radius))).otherwise(F.array(F.lit(0)))
    near = anchors.select("key", "place", F.explode(offsets).alias("_step")).select("key", (F.col("place") + F.col("_step")).alias("place")).distinct()
    return near.join(rows.select("key", "place"), ["key", "place"], "left_semi")
