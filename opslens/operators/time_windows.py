"""Sliding windows, anomaly rules, regions and time profiles over log events (event_s in seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_text, text_rules
from .compression import best
from .lineage import cut

SIZE, STEP = 300, 60
MERGE_GAP = 60
SEGMENT_GAP_HOURS = 6


def _first(events: DataFrame, step: int) -> DataFrame:
    """One row: the start of the first window."""
    return events.agg((F.floor(F.min("event_s") / step) * step).alias("first"))


def window_rows(events: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """The events once for each half-open window that holds them; no window starts before the first event's step.

    A window is found from the event's own time, so nothing is joined but the one row that holds the first start."""
    newest = F.floor(F.col("event_s") / step) * step
    starts = F.sequence(newest - (size - step), newest, F.lit(step).cast("long"))
    return events.select("*", F.explode(starts).alias("window_start")).join(F.broadcast(_first(events, step))).filter("window_start >= first").drop("first")


def window_counts(events: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """window_start, window_end, event_count, error_count, technical_error_count, root_signal_count, n_services.

    Events are counted by step and service first; only these few rows are spread over windows."""
    flags = ("is_error", "is_technical", "is_atomic")
    at = (F.floor(F.col("event_s") / step) * step).alias("step_s")
    steps = log_text.flagged(events).groupBy(at, "service").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in flags))
    starts = F.sequence(F.col("step_s") - (size - step), F.col("step_s"), F.lit(step).cast("long"))
    counted = steps.select("*", F.explode(starts).alias("window_start")).groupBy("window_start").agg(
        F.sum("n").alias("event_count"), F.sum("is_error").alias("error_count"), F.sum("is_technical").alias("technical_error_count"),
        F.sum("is_atomic").alias("root_signal_count"), F.count_distinct("service").alias("n_services"), F.min("step_s").alias("_low"),
    )
    # Over one row a window: the first step of all is told by the windows themselves, so events are read once.
    first = F.min("_low").over(Window.partitionBy())
    return counted.withColumn("_first", first).filter("window_start >= _first").drop("_low", "_first").withColumn("window_end", F.col("window_start") + size)


def window_annotations(events: DataFrame, size: int = SIZE, step: int = STEP, most: int = 10) -> DataFrame:
    """window_start, services (sorted) and trace_ids (the `most` most frequent ones) of each window's errors and warnings, or of
    all its events where it has none.

    Events are counted by step, service and trace first, and only counts are spread over windows."""
    signal = F.upper("level").isin("ERROR", "FATAL", "WARN")
    at = (F.floor(F.col("event_s") / step) * step).alias("step_s")
    steps = cut(events.groupBy(at, "service", F.coalesce("trace_id", F.lit("")).alias("trace_id"), signal.alias("signal")).agg(F.count(F.lit(1)).alias("n")))
    starts = F.sequence(F.col("step_s") - (size - step), F.col("step_s"), F.lit(step).cast("long"))
    first = steps.agg(F.min("step_s").alias("_first"))
    rows = steps.select("*", F.explode(starts).alias("window_start")).join(F.broadcast(first)).filter("window_start >= _first")
    quiet = steps.groupBy("step_s").agg(F.max("signal").alias("signal")).select(F.explode(starts).alias("window_start"), "signal").groupBy("window_start").agg((~F.max("signal")).alias("_quiet"))
    shown = rows.join(quiet, "window_start").filter("signal or _quiet")
    services = shown.groupBy("window_start").agg(F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services"))
    traces = shown.filter("trace_id <> ''").groupBy("window_start", "trace_id").agg(F.sum("n").alias("n"))
    # A window's traces are ranked by what each of some parts keeps of them.
    top = best(traces, ["window_start"], [F.col("n").desc(), "trace_id"], most)
    top = top.groupBy("window_start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "trace_id"))), lambda x: x["trace_id"]), ",").alias("trace_ids"))
    return services.join(top, "window_start", "left").withColumn("trace_ids", F.coalesce("trace_ids", F.lit("")))


def flag_windows(counts: DataFrame) -> DataFrame:
    """The windows with is_anomaly and anomaly_reason by the fault rules."""
    reasons = F.array_compact(
        F.array(F.when(F.col("technical_error_count") > 0, F.lit("technical_error_rule")), F.when(F.col("root_signal_count") > 0, F.lit("root_signal_rule")))
    )
    return counts.withColumn("is_anomaly", F.size(reasons) > 0).withColumn("anomaly_reason", F.when(F.size(reasons) > 0, F.array_join(reasons, "+")).otherwise("normal"))


def islands(rows: DataFrame, start: str, end: str, gap: int, keys=()) -> DataFrame:
    """The rows with `region`: a row opens a new one if it starts more than `gap` after all earlier ends.

    Without keys the order is over all windows: these are few, one a step of time, whatever the number of events."""
    along = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("region", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def anomaly_regions(windows: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """region, region_start, region_end, window_count, max_events, detection_source of merged anomalous windows."""
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("anomaly_reason", r"\+"))))), "+")
    return (
        islands(windows.filter("is_anomaly"), "window_start", "window_end", gap)
        .groupBy("region")
        .agg(F.min("window_start").alias("region_start"), F.max("window_end").alias("region_end"), F.count(F.lit(1)).alias("window_count"), F.max("event_count").alias("max_events"), reasons.alias("detection_source"))
    )


def hour_buckets(events: DataFrame) -> DataFrame:
    """hour_s, events, errors, first_s, last_s."""
    return events.groupBy((F.floor(F.col("event_s") / 3600) * 3600).alias("hour_s")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(log_text.is_error(F.col("level")).cast("long")).alias("errors"), F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s")
    )


def log_segments(buckets: DataFrame, gap_hours: int = SEGMENT_GAP_HOURS) -> DataFrame:
    """segment, start_s, end_s, events, errors: a new segment opens where hours are more than the gap apart."""
    return (
        islands(buckets.withColumn("_end", F.col("hour_s")), "hour_s", "_end", gap_hours * 3600)
        .groupBy(F.col("region").alias("segment"))
        .agg(F.min("first_s").alias("start_s"), F.max("last_s").alias("end_s"), F.sum("events").alias("events"), F.sum("errors").alias("errors"))
    )


def recommended_range(buckets: DataFrame, before: int = 900, after: int = 4200, last_hours: int = 24) -> DataFrame:
    """One row: the range around the hour with most errors (then events, then the latest), else the last hours."""
    peak = F.max_by("hour_s", F.struct("errors", "events", "hour_s"))
    row = buckets.agg(peak.alias("peak_s"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.sum("errors").alias("errors"))
    return row.select(
        "peak_s",
        F.when(F.col("errors") > 0, F.greatest("first_s", F.col("peak_s") - before)).otherwise(F.greatest("first_s", F.col("last_s") - last_hours * 3600)).alias("start_s"),
        F.when(F.col("errors") > 0, F.least("last_s", F.col("peak_s") + after)).otherwise(F.col("last_s")).alias("end_s"),
    )


def level_profile(events: DataFrame) -> DataFrame:
    """level, n, first_s, last_s."""
    return events.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("event_s").alias("first_s"), F.max("event_s").alias("last_s"))


def window_features(events: DataFrame, size: int = SIZE, step: int = STEP, min_events: int = 1) -> DataFrame:
    """window_id, window_start, feature, n: how often each service's masked message stands in each window that has enough events.

    Events are counted by step and feature first; only counts are spread over windows. Window numbers are given over one row a window."""
    feature = text_rules.feature_name(F.col("service"), log_text.mask(F.col("message")))
    steps = events.groupBy((F.floor(F.col("event_s") / step) * step).alias("event_s"), feature.alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    counted = window_rows(steps, size, step).groupBy("window_start", "feature").agg(F.sum("n").alias("n"))
    windows = counted.groupBy("window_start").agg(F.sum("n").alias("_all")).filter(F.col("_all") >= min_events)
    windows = windows.select("window_start", F.format_string("W%06d", F.row_number().over(Window.orderBy("window_start"))).alias("window_id"))
    return counted.join(windows, "window_start").select("window_id", "window_start", "feature", "n")


def contributors(features: DataFrame, most: int = 10) -> DataFrame:
    """window_id, feature, n, z, place: the features of each window that stand out most, by distance from their mean over all
    windows in population deviations; windows without a feature count as 0."""
    n_windows = features.agg(F.count_distinct("window_id").alias("_windows"))
    stats = features.groupBy("feature").agg(F.sum("n").alias("_sum"), F.sum(F.col("n") * F.col("n")).alias("_squares")).join(F.broadcast(n_windows))
    mean = F.col("_sum") / F.col("_windows")
    stats = stats.select("feature", mean.alias("_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_windows") - mean * mean)).alias("_deviation"))
    z = F.round(F.when(F.col("_deviation") > 0, (F.col("n") - F.col("_mean")) / F.col("_deviation")).otherwise(0.0), 6)
    scored = features.join(stats, "feature").select("window_id", "feature", "n", z.alias("z"))
    place = F.row_number().over(Window.partitionBy("window_id").orderBy(F.abs("z").desc(), "feature")).cast("long")
    return scored.withColumn("place", place).filter(F.col("place") <= most)


def aligned_features(train: DataFrame, target: DataFrame) -> DataFrame:
    """feature, n_train, n_target over the features of both, 0 where one lacks it."""
    both = train.select("feature", F.col("n").alias("n_train"), F.lit(0).cast("long").alias("n_target")).unionByName(target.select("feature", F.lit(0).cast("long").alias("n_train"), F.col("n").alias("n_target")))
    return both.groupBy("feature").agg(F.sum("n_train").alias("n_train"), F.sum("n_target").alias("n_target"))


def in_windows(events: DataFrame, windows: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """The events that one of the windows (window_start) holds: a semi join on the starts that an event's step has."""
    steps = events.select((F.floor(F.col("event_s") / step) * step).alias("_step")).distinct()
    starts = steps.select("_step", F.explode(F.sequence(F.col("_step") - (size - step), F.col("_step"), F.lit(step).cast("long"))).alias("window_start"))
    held = starts.join(windows.select("window_start"), "window_start", "left_semi").select("_step").distinct()
    return events.withColumn("_step", F.floor(F.col("event_s") / step) * step).join(held, "_step", "left_semi").drop("_step")


def with_model(windows: DataFrame, flagged: DataFrame) -> DataFrame:
    """The windows with a model's flag before the rules' reasons: flagged holds the window_start of those that a model found."""
    known = windows.join(flagged.select("window_start", F.lit(True).alias("_model")), "window_start", "left").withColumn("_model", F.coalesce("_model", F.lit(False)))
    reason = F.when(~F.col("_model"), F.col("anomaly_reason")).when(F.col("anomaly_reason") == "normal", F.lit("model")).otherwise(F.concat(F.lit("model+"), F.col("anomaly_reason")))
    return known.withColumns({"anomaly_reason": reason, "is_anomaly": F.col("_model") | F.col("is_anomaly")}).drop("_model")
