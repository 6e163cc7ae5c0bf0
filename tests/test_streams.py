"""Streams: tumbling and session windows, log lines, and traces told once."""

import datetime

from opslens.streaming import windows as streaming

START = datetime.datetime(2026, 1, 1)
SCHEMA = "event_ts timestamp, level string, service string, trace_id string, message string"


def _rows(*seconds, trace="t1", level="ERROR", service="a"):
    return [(START + datetime.timedelta(seconds=s), level, service, trace, "x") for s in seconds]


def _ran(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    return query


def test_tumbling_and_session_windows(spark, tmp_path):
    rows = _rows(0, 60, 3599, level="INFO") + _rows(3600, 7199) + _rows(40_000, service="b")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    _ran(streaming.stream_hour_buckets(stream), "hours", "complete").stop()
    assert sorted(r[:] for r in spark.sql("select events, errors from hours").collect()) == [(1, 1), (2, 2), (3, 0)]
    _ran(streaming.stream_segments(stream, gap="30 minutes"), "segments", "complete").stop()
    assert sorted(r[:] for r in spark.sql("select service, events from segments").collect()) == [("a", 1), ("a", 2), ("a", 2), ("b", 1)]


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("26/01/20 14:12:20.100 INFO --- [main] c.a.Start : up\nno header\n")
    _ran(streaming.stream_lines(spark, str(tmp_path)), "lines", "append").stop()
    assert [(r.level, r.message, r.event_ts) for r in spark.table("lines").collect()] == [("INFO", "up", datetime.datetime(2026, 1, 20, 14, 12, 20, 100000))]


def test_traces_are_told_once(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    put(0, _rows(0, 10) + _rows(5, level="INFO") + _rows(7, trace=""))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = _ran(streaming.stream_traces(stream), "traces", "append")
    assert spark.table("traces").count() == 0
    for n, second in ((1, 5000), (2, 9000), (3, 13_000)):
        put(n, _rows(second, trace=f"u{n}"))
        query.processAllAvailable()
    query.stop()
    first = [r for r in spark.table("traces").collect() if r.trace_id == "t1"]
    at = int((START - datetime.datetime(1970, 1, 1)).total_seconds())
    assert [(r.events, r.errors, r.first_s - at, r.last_s - at) for r in first] == [(3, 2, 0, 10)]
