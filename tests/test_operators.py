"""Operators on small inputs: log files, text functions, graphs, models, streams."""

import datetime
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.functions import log_text
from opslens.operators import graph, models, reports, time_windows
from opslens.sources import log_events
from opslens.streaming import windows as streaming

LOG = """this line precedes any header and is dropped
26/01/20 14:12:20.100 INFO --- [main] c.a.Start :[546d9959] request received
26/01/20 14:12:21.240 ERROR --- [http-nio-7100-exec-11] c.a.Sec :[546d9959] query failed
org.springframework.QueryTimeoutException: Redis command timed out
	at a.b.C.d(C.java:10)
Suppressed: java.io.IOException: ignored
Caused by: io.lettuce.core.RedisCommandTimeoutException: Command timed out after 20 seconds
	... 12 more
2026-01-20 14:12:22.000 WARN --- [t1] c.a.Sec : trace_id=abcd1234 downstream=redis-2 slow
"""
CAUSE = "io.lettuce.core.RedisCommandTimeoutException: Command timed out after 20 seconds"


def _told(found):
    assert [r.source_line for r in found] == [2, 3, 9]
    assert found[0].message == "request received" and found[0].trace_id == "546d9959" and found[0].exception_chain == "[]"
    assert found[1].exception_class == "org.springframework.QueryTimeoutException"
    assert found[1].root_exception_class == "io.lettuce.core.RedisCommandTimeoutException" and found[1].root_cause == CAUSE
    assert found[1].semantic_message == f"query failed | org.springframework.QueryTimeoutException | {CAUSE}"
    assert found[1].raw_block.count("\n") == 5 and [e["kind"] for e in json.loads(found[1].exception_chain)] == ["direct", "suppressed", "caused_by"]
    assert (found[2].trace_id, found[2].downstream, found[2].level) == ("abcd1234", "redis-2", "WARN")
    assert found[0].event_ts == datetime.datetime(2026, 1, 20, 14, 12, 20, 100000) and found[2].event_ts == datetime.datetime(2026, 1, 20, 14, 12, 22)


def test_log_files(spark, tmp_path):
    (tmp_path / "node-1").mkdir()
    (tmp_path / "node-1" / "security-service-7100.log").write_text(LOG)
    (tmp_path / "node-1" / "security-service-7100-err.log").write_text(LOG)
    (tmp_path / "node-1" / "notes.txt").write_text(LOG)
    found = log_events.read_logs(spark, str(tmp_path)).orderBy("source_line").collect()
    assert {(r.service, r.instance) for r in found} == {("security-service", "node-1")}
    _told(found)
    assert log_events.read_logs(spark, str(tmp_path), include=("*.txt", "*-err.log"), exclude=()).count() == 6
    # The whole block decides on the family: the suppressed IOException is of the first one that the block names.
    flagged = {r.source_line: (r.family, r.is_technical) for r in log_text.flagged(log_events.read_logs(spark, str(tmp_path))).collect()}
    assert flagged[3] == ("disk", True) and flagged[2] == ("unknown", False)


def test_long_log_files_in_parts(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"26/01/20 14:12:20.100 INFO --- [main] c.a.Start :[{i:08d}] one\nmore of {i}\n\nand more\n" for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = log_events.read_logs(spark, str(tmp_path)).select("source_line", "trace_id", "raw_block").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(found) == 3000 and {(r.source_line, r.trace_id) for r in found} == {(4 * i + 1, f"{i:08d}") for i in range(3000)}
    assert all(r.raw_block.endswith(f"more of {int(r.trace_id)}\n\nand more") for r in found)


def test_zip_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as file:
        file.writestr("node-1/security-service-7100.log", LOG)
    _told(log_events.read_zips(spark, str(tmp_path)).orderBy("source_line").collect())
    for number, name in enumerate(("../out.log", "/etc/x.log", "run.sh")):
        (tmp_path / str(number)).mkdir()
        with zipfile.ZipFile(tmp_path / str(number) / "b.zip", "w") as file:
            file.writestr(name, LOG)
        with pytest.raises(Exception, match="refused member"):
            log_events.read_zips(spark, str(tmp_path / str(number))).count()
    with pytest.raises(Exception, match="more than 0 members"):
        log_events.read_zips(spark, str(tmp_path), max_members=0).count()


def test_text_functions(spark):
    rows = [("Took 12ms for 10.0.0.1 id=abcdefgh12",), ("",), (None,)]
    found = spark.createDataFrame(rows, "m string").select(log_text.mask(F.col("m")), log_text.normalise_pattern(F.col("m")), log_text.fault_family(F.col("m"))).collect()
    assert found[0][0] == "Took <*> for <*> id=abcdefgh12"
    assert found[0][1] == "took <num> for <ip> id=<id>"
    assert found[1][1] == "<empty>" and found[2][2] == "unknown"


def test_islands_open_after_the_gap(spark):
    rows = spark.createDataFrame([(0, 10), (5, 20), (21, 30), (32, 40)], "a long, b long")
    assert [r.region for r in time_windows.islands(rows, "a", "b", 1).orderBy("a").collect()] == [1, 1, 1, 2]


def test_search_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "OTHER")], "source string, target string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r)[1:] for r in graph.bounded_search(edges, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r)[1:] for r in graph.bounded_search(edges, seeds, 1, reverse=True).collect()} == {("a", 0), ("c", 1)}


def test_page_is_clamped(spark):
    rows = spark.createDataFrame([(i, 0, "open", "low", "x", i) for i in range(23)], "id long, project long, status string, severity string, root string, created long")
    found = reports.page(rows, number=9, size=10).collect()
    assert [r.id for r in found] == [2, 1, 0] and found[0].pages == 3 and found[0].total == 23


def test_forest_finds_the_outlier(spark):
    x = np.random.default_rng(1).normal(size=(300, 4))
    x[17] = 12
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    scored = models.isolation_scores(rows, "id", "v", trees=40).orderBy(F.col("score").desc())
    assert scored.first().id == 17
    assert models.isolation_scores(rows.limit(0), "id", "v").count() == 0


def test_stream_counts(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1, 0, 0, 30)
    rows = [(t, "ERROR", "deadlock"), (t + datetime.timedelta(minutes=1), "INFO", "fine")]
    spark.createDataFrame(rows, "event_ts timestamp, level string, message string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_ts timestamp, level string, message string").parquet(str(tmp_path / "in"))
    query = streaming.stream_window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select max(event_count), max(technical_error_count), count(*) from counts").first()[:] == (2, 1, 6)
