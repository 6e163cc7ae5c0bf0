"""Streaming forms of the window counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import log_text
from ..sources import log_events


def stream_window_counts(events: DataFrame, size: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, event_count, error_count, technical_error_count, root_signal_count of a stream with event_ts; late rows beyond the watermark are dropped."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return (
        log_text.flagged(events)
        .withWatermark("event_ts", late)
        .groupBy(F.window("event_ts", size, step))
        .agg(F.count(F.lit(1)).alias("event_count"), count("is_error").alias("error_count"), count("is_technical").alias("technical_error_count"), count("is_atomic").alias("root_signal_count"))
    )


def stream_hour_buckets(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, events, errors of tumbling windows."""
    counted = events.withWatermark("event_ts", late).groupBy(F.window("event_ts", size))
    return counted.agg(F.count(F.lit(1)).alias("events"), F.sum(log_text.is_error(F.col("level")).cast("long")).alias("errors"))


def stream_segments(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """session_window, service, events: each service's stretches of events that lie no further apart than the gap."""
    return events.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap), "service").agg(F.count(F.lit(1)).alias("events"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The header lines of log files that are put into a folder, as they come: event_ts, level, thread, logger, message."""
    lines = spark.readStream.format("text").load(path).filter(F.col("value").rlike(log_events.HEADER))
    part = lambda i: F.regexp_extract("value", log_events.HEADER, i)
    return lines.select(log_events.event_time(part(1)).cast("timestamp").alias("event_ts"), part(2).alias("level"), part(3).alias("thread"), part(4).alias("logger"), part(5).alias("message"))


def stream_traces(events: DataFrame, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """trace_id, events, errors, first_s, last_s of each trace, told once, when the watermark has passed its last event by the
    idle time. A trace's state is five numbers, and goes when it is told."""
    seconds = F.expr(f"cast(interval '{idle}' as interval second)").cast("decimal(18,6)")
    wait_ms = int(float(events.sparkSession.range(1).select(seconds).first()[0]) * 1000)

    def run(key, batches, state):
        n, errors, first, last = state.getOption or (0, 0, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, errors, first, last)], columns=["trace_id", "events", "errors", "first_s", "last_s"])
            return
        for pdf in batches:
            n, errors = n + len(pdf), errors + int(pdf["is_error"].sum())
            low, high = int(pdf["event_s"].min()), int(pdf["event_s"].max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
        state.update((n, errors, first, last))
        state.setTimeoutTimestamp(max(last * 1000 + wait_ms, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("event_ts", late).filter("trace_id <> ''").select("trace_id", "event_ts", F.unix_seconds("event_ts").alias("event_s"), log_text.is_error(F.col("level")).alias("is_error"))
    return rows.groupBy("trace_id").applyInPandasWithState(
        run, "trace_id string, events long, errors long, first_s long, last_s long", "events long, errors long, first_s long, last_s long", "append", GroupStateTimeout.EventTimeTimeout
    )
