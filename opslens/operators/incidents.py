"""From anomalous regions to incidents: members, root candidates, patterns, traces, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_text
from .lineage import cut, small

REGION_STEP = 3600


def in_regions(events: DataFrame, regions: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """The events inside regions [start - before, end + after): joined on the hours that a region touches, then compared.

    The join is on equal hours, so it needs no product of both sides; the hours of the regions, of which a year has some
    thousands, are broadcast where they are few, else both sides are shuffled by hour."""
    spans = regions.select("region", "region_start", "region_end", (F.col("region_start") - before).alias("_low"), (F.col("region_end") + after).alias("_high"))
    hours = F.sequence(F.floor(F.col("_low") / REGION_STEP), F.floor((F.col("_high") - 1) / REGION_STEP))
    spans = spans.withColumn("_hour", F.explode(hours))
    keyed = events.withColumn("_hour", F.floor(F.col("event_s") / REGION_STEP))
    return keyed.join(small(spans), "_hour").filter("event_s >= _low and event_s < _high").drop("_hour", "_low", "_high")


#: Seconds of context before and after a fault.
BEFORE, AFTER = 60, 120
ROLES = ("context", "related_error", "error", "root_candidate")


def incident_context(events: DataFrame, regions: DataFrame, primary: DataFrame, candidates: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """region, event_id, role of the events that tell an incident: those from `before` its first primary event to `after` its
    last, both ends included, those of its primary traces inside the detected range, and the primary ones (region, event_id,
    event_s, trace_id) themselves. The first candidate (region, place, event_id) is the root candidate, primary events are
    errors, other errors related ones, the rest context. An event of several arms comes once."""
    spans = cut(primary.groupBy("region").agg(F.min("event_s").alias("region_start"), (F.max("event_s") + 1).alias("region_end")))
    near = in_regions(events, spans, before, after).select("region", "event_id", "level")
    traces = primary.filter("trace_id <> ''").select("region", "trace_id").distinct().join(small(regions.select("region", "region_start", "region_end")), "region")
    traced = events.select("event_id", "event_s", "level", "trace_id").join(traces, "trace_id").filter("event_s >= region_start and event_s < region_end").select("region", "event_id", "level")
    rank = lambda c, n: F.when(c, n).otherwise(0)
    told = near.unionByName(traced).select("region", "event_id", rank(log_text.is_error(F.col("level")), 1).alias("rank"))
    told = told.unionByName(primary.select("region", "event_id", F.lit(2).alias("rank"))).unionByName(candidates.filter("place = 1").select("region", "event_id", F.lit(3).alias("rank")))
    # A candidate is a primary event, so no event comes in by its role alone.
    roles = told.groupBy("region", "event_id").agg(F.max("rank").alias("rank"))
    return roles.select("region", "event_id", F.element_at(F.array(*map(F.lit, ROLES)), F.col("rank") + 1).alias("role"))


def unassigned_errors(events: DataFrame, members: DataFrame) -> DataFrame:
    """Errors that no region holds."""
    return events.filter(log_text.is_error(F.col("level"))).join(members.select("event_id").distinct(), "event_id", "left_anti")


def candidate_scores(members: DataFrame) -> DataFrame:
    """The error members of regions with exception_key (root class, else class, else family) and root-candidate score.

    Level, exception class, root keywords, passed-on errors, closeness to the region's first error, and rarity of the key
    count. First errors and rarities are counted before they are joined, as one region may hold most events. The errors are
    checkpointed, so that what is read of the log is read once."""
    errors = log_text.flagged(members).filter("is_error")
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    errors = cut(errors.withColumn("exception_key", F.coalesce(known("root_exception_class"), known("exception_class"), "family")))
    keys = errors.groupBy("region", "exception_key").agg(F.count(F.lit(1)).alias("_same"), F.min("event_s").alias("_first"))
    keys = keys.withColumn("_start", F.min("_first").over(Window.partitionBy("region"))).drop("_first")
    level = F.when(F.col("level") == "FATAL", 7.0).when(F.col("level") == "ERROR", 5.0).when(F.col("level") == "WARN", 1.0).otherwise(0.0)
    named = F.when(known("root_exception_class").isNotNull(), 4.0).when(known("exception_class").isNotNull(), 2.0).otherwise(0.0)
    late = F.greatest(F.lit(0.0), 3.0 - F.greatest(F.col("event_s") - F.col("_start"), F.lit(0)) / 60.0)
    score = level + named + F.when(F.col("is_atomic"), 10.0).otherwise(0.0) - F.when(F.col("is_wrapper"), 12.0).otherwise(0.0) + late + 3.0 / F.sqrt("_same")
    return errors.join(small(keys), ["region", "exception_key"]).withColumn("score", F.round(score, 6)).drop("_same", "_start")


def root_candidates(scored: DataFrame, most: int = 30) -> DataFrame:
    """Per region the best event of each exception key first, then others, by score, time and id: region, place, event_id.

    The best of each key and the best of all hold every place, and tasks reduce both before they are dealt out by region."""
    order, columns = [F.col("score").desc(), "event_s", "event_id"], ("event_id", "event_s", "family", "score")
    best = F.min_by(F.struct(*columns), F.struct(-F.col("score"), "event_s", "event_id")).alias("best")
    first = scored.groupBy("region", "exception_key").agg(best).select("region", *(F.col(f"best.{c}").alias(c) for c in columns), F.lit(1).alias("first"))
    rank = F.row_number().over(Window.partitionBy("region").orderBy(*order))
    others = scored.select("region", *columns).withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    others = others.join(first.select("region", "event_id"), ["region", "event_id"], "left_anti").select("region", *columns, F.lit(0).alias("first"))
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.col("first").desc(), *order))
    return first.unionByName(others).withColumn("place", place).filter(F.col("place") <= most).select("region", F.col("place").cast("long").alias("place"), "event_id", "family", "score")


def exception_summary(scored: DataFrame) -> DataFrame:
    """Per region and exception key of scored errors: n, first_s, last_s, n_services, n_traces, and the event with the best
    score (the earliest of equals, then the least id)."""
    return scored.groupBy("region", "exception_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s"), F.count_distinct("service").alias("n_services"),
        F.count_distinct(F.when(F.col("trace_id") != "", F.col("trace_id"))).alias("n_traces"),
        F.min_by("event_id", F.struct(-F.col("score"), "event_s", "event_id")).alias("representative"),
    )


def top_traces(members: DataFrame, most: int = 10) -> DataFrame:
    """Per region its most frequent traces: region, trace_id, n."""
    counted = members.filter("trace_id <> ''").groupBy("region", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.col("n").desc(), "trace_id"))
    return counted.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def masked_templates(events: DataFrame) -> DataFrame:
    """template, n, first_id of masked messages."""
    return events.groupBy(log_text.mask(F.col("message")).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def pattern_frequency(events: DataFrame) -> DataFrame:
    """Per level, service and normalised pattern: n, first_s, last_s."""
    return events.groupBy("level", "service", log_text.normalise_pattern(F.col("message")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s"))


def importance_scores(events: DataFrame, evidence: list[str] = ()) -> DataFrame:
    """The events with signature, frequency and score: level, signals, root cause, exception class, rarity of the signature
    (at most 4), trace, and words shared with the evidence (at most 6).

    Signatures are counted before the events are joined to them, as one may hold most events."""
    from ..functions import text_rules

    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c in events.columns else F.lit(False)
    known = events.withColumn("signature", text_rules.signature(events.columns))
    seen = known.groupBy("signature").agg(F.count(F.lit(1)).alias("frequency"))
    named = has("root_exception_class") | has("exception_class")
    said = text_rules.event_message(events.columns)
    words = F.concat_ws(" ", said, *(F.col(c) for c in ("root_cause", "service", "root_exception_class") if c in events.columns))
    overlap = F.size(F.array_intersect(text_rules.evidence_tokens(words), F.array(*map(F.lit, evidence)))) if evidence else F.lit(0)
    score = (
        log_text.level_weight(F.col("level")) + log_text.signal_weight(said) + F.when(has("root_cause"), 4.0).otherwise(0.0) + F.when(named, 3.0).otherwise(0.0)
        + F.least(F.lit(4.0), 4.0 / F.sqrt("frequency")) + F.when(has("trace_id"), 0.5).otherwise(0.0) + F.least(F.lit(6.0), 1.5 * overlap)
    )
    return known.join(seen, "signature").withColumn("score", score)


def temporal_edges(events: DataFrame) -> DataFrame:
    """Within each trace, steps between successive events of different services: source, target, n."""
    along = Window.partitionBy("trace_id").orderBy("event_s", "event_id")
    steps = events.filter("trace_id <> ''").withColumn("target", F.lead("service").over(along)).filter("target <> service")
    return steps.groupBy(F.col("service").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


def incident_rows(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per region: its number, span, counts, services and traces, its most frequent trace, and its first candidate."""
    # Members are counted by trace once; facts of a region come from these counts.
    counted = cut(members.groupBy("region", F.coalesce("trace_id", F.lit("")).alias("trace_id")).agg(
        F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s"), F.count(F.lit(1)).alias("n"), F.sum(log_text.is_error(F.col("level")).cast("long")).alias("errors"), F.collect_set("service").alias("services"),
    ))
    served = F.array_distinct(F.flatten(F.collect_set("services")))
    facts = counted.groupBy("region").agg(
        F.min("first_s").alias("fault_start"), F.max("last_s").alias("fault_end"), F.sum("n").alias("n_events"), F.sum("errors").alias("n_errors"),
        F.array_join(F.sort_array(served), ",").alias("services"), F.count_if(F.col("trace_id") != "").alias("n_traces"),
        F.min_by(F.when(F.col("trace_id") != "", F.col("trace_id")), F.struct((F.col("trace_id") == "").alias("_no"), -F.col("n"), "trace_id")).alias("primary_trace"),
    )
    first = candidates.filter("place = 1").select("region", F.col("event_id").alias("root_event"), F.col("family").alias("root_family"))
    # One row a region: few, whatever the number of events.
    number = F.format_string("I%05d", F.row_number().over(Window.orderBy("fault_start", "fault_end", "region")))
    return facts.join(first, "region", "left").withColumn("incident", number)


def incident_records(members: DataFrame, scored: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per region with members: incident, start, end, detected_start, detected_end, fault_start, fault_end, max_score,
    window_count, event_count, error_count, exception_class_count, exception_classes, services, n_traces, primary_trace,
    root_service, root_cause, root_exception_class, detection_source.

    scored and candidates are what candidate_scores() and root_candidates() give of the members. Classes are in the order of
    their counts. The root is the first candidate, where a region has no errors its first event. max_score is that of the
    regions if they carry one (from a model's windows), else 0. A region's traces may be as many as its events, so they are
    rows of incident_traces() and only counted here."""
    rows = incident_rows(members, candidates)
    classes = scored.groupBy("region", "exception_key").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(
        F.count(F.lit(1)).alias("exception_class_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "exception_key"))), lambda x: x["exception_key"]), ",").alias("exception_classes")
    )
    said = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in ("root_cause", "semantic_message", "message") if c in members.columns), F.lit(""))
    known = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("root_exception_class", "exception_class")), F.lit(""))
    told = F.struct("service", said.alias("said"), known.alias("class"))
    # One row a region each: the events of first candidates, and first events.
    first = scored.join(small(candidates.filter("place = 1").select("region", "event_id")), ["region", "event_id"], "left_semi").select("region", told.alias("root"))
    opening = members.groupBy("region").agg(F.min_by(told, F.struct("event_s", "event_id")).alias("opening"))
    score = F.col("max_score") if "max_score" in regions.columns else F.lit(0.0)
    spans = regions.select("region", F.col("region_start").alias("detected_start"), F.col("region_end").alias("detected_end"), score.cast("double").alias("max_score"), "window_count", "detection_source")
    whole = rows.join(spans, "region").join(classes, "region", "left").join(opening, "region").join(first, "region", "left").withColumn("root", F.coalesce("root", "opening"))
    return whole.select(
        "incident", F.col("fault_start").alias("start"), F.col("fault_end").alias("end"), "detected_start", "detected_end", "fault_start", "fault_end", "max_score", "window_count",
        F.col("n_events").alias("event_count"), F.col("n_errors").alias("error_count"), F.coalesce("exception_class_count", F.lit(0)).alias("exception_class_count"), F.coalesce("exception_classes", F.lit("")).alias("exception_classes"),
        "services", "n_traces", F.coalesce("primary_trace", F.lit("")).alias("primary_trace"), F.col("root.service").alias("root_service"), F.col("root.said").alias("root_cause"), F.col("root.class").alias("root_exception_class"), "detection_source",
    )


def incident_traces(members: DataFrame) -> DataFrame:
    """region, trace_id, n, errors: every trace that a region's events belong to."""
    return members.filter("trace_id <> ''").groupBy("region", "trace_id").agg(F.count(F.lit(1)).alias("n"), F.sum(log_text.is_error(F.col("level")).cast("long")).alias("errors"))


def run_summary(events: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: events, errors, technical errors, classes that were parsed, regions, assigned events, classes of first candidates."""
    flagged = log_text.flagged(events)
    whole = flagged.agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("is_error").cast("long")).alias("errors"), F.sum(F.col("is_technical").cast("long")).alias("technical_errors"),
        F.count_distinct(F.when(F.col("root_exception_class") != "", F.col("root_exception_class"))).alias("classes"),
    )
    held = members.agg(F.count_distinct("region").alias("regions"), F.count_distinct("event_id").alias("assigned"))
    first = candidates.filter("place = 1").agg(F.count_distinct("family").alias("promoted"))
    # Three tables of one row each.
    return whole.join(F.broadcast(held)).join(F.broadcast(first))


def class_audit(events: DataFrame, members: DataFrame) -> DataFrame:
    """class, n, assigned, regions: errors by exception class, and in how many regions they lie."""
    errors = events.filter(log_text.is_error(F.col("level")) & (F.col("root_exception_class") != "")).select("event_id", F.col("root_exception_class").alias("class"))
    held = errors.join(members.select("event_id", "region"), "event_id")
    counted = held.groupBy("class").agg(F.count_distinct("event_id").alias("assigned"), F.count_distinct("region").alias("regions"))
    total = errors.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return total.join(counted, "class", "left").select("class", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("assigned", "regions")))


def trace_events(events: DataFrame, trace_id: str) -> DataFrame:
    """The events of one trace in order: place, event_id, event_s, level, service."""
    place = F.row_number().over(Window.orderBy("event_s", "event_id")).cast("long")
    return events.filter(F.col("trace_id") == trace_id).select(place.alias("place"), "event_id", "event_s", "level", "service")
