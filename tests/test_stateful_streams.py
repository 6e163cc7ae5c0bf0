"""Streams with state: episodes as in the batch, templates, late rows, idle keys, and progress rows."""

import random
import time

import pytest
from test_episodes import SCHEMA, plain_episodes

from opslens.streaming import progress, stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        time.sleep(0.02)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def _ran(spark, stream, name, rows, most=90):
    """Runs a stream until it has told so many rows; a stream with timers of processing time never comes to rest by itself."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    deadline = time.time() + most
    while time.time() < deadline and query.isActive and spark.table(name).count() < rows:
        time.sleep(0.5)
    query.stop()
    return spark.table(name).collect()


def test_episodes_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    rnd, at, rows = random.Random(4), 0, []
    for i in range(240):
        at += rnd.choice([0, 5, 30, 100, 400, 700])
        pick = lambda n, *more: rnd.choice([*(f"{n}{j}" for j in range(3)), *more])
        rows.append((i, at, rnd.choice([f"t{i // 3}", ""]), pick("svc", ""), pick("svc", ""), pick("f"), pick("k"), rnd.random() < 0.1, rnd.random() < 0.1))
    want = {"a": plain_episodes(rows[::2]), "b": plain_episodes(rows[1::2])}
    keyed = [("a" if r[0] % 2 == 0 else "b", *r) for r in rows]
    mixed = [sorted(keyed[i : i + 40], key=lambda r: rnd.random()) for i in range(0, 240, 40)]
    # Each batch comes in disorder; a last row a key lets all others pass, and one comes long after its time.
    late = [("a", 900, rows[0][1], "", "svc0", "", "f0", "k0", False, False)]
    end = [(k, 990 + i, at + 100_000, "", "svc0", "", "f0", "k0", False, False) for i, k in enumerate("ab")]
    stream = _stream(rocks, tmp_path, [*mixed, end, late], "key string, " + SCHEMA)
    found = _ran(rocks, stateful.stream_episodes(stream, late=5000, idle_ms=600_000), "episodes", 241)
    assert [(r.event_id, r.episode) for r in found if r.late] == [("900", None)]
    for key, episodes in want.items():
        assert {r.event_id: r.episode for r in found if r.key == key and not r.late} == {str(k): str(v) for k, v in episodes.items()}


def test_templates_of_a_stream_and_idle_keys(rocks, tmp_path):
    rows = [("k", str(i), i, f"user u{i} logged in") for i in range(6)] + [("k", "9", 9, "disk full"), ("k", "8", 8, "")]
    stream = _stream(rocks, tmp_path, [rows[:4], rows[4:]], "key string, event_id string, event_s long, message string")
    found = {r.event_id: (r.template_id, r.template) for r in _ran(rocks, stateful.stream_templates(stream, late=1000, idle_ms=3000), "mined", 8)}
    # Nothing passes the watermark by itself: the timer takes it.
    assert len(found) == 8 and {found[str(i)][0] for i in range(6)} == {1} and found["5"][1] == "user <*> logged in"
    assert found["8"][1] == "" and found["9"] == (3, "disk full")


def test_progress_rows(spark, tmp_path):
    path = str(tmp_path / "progress")
    listener = progress.ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        from pyspark.sql import functions as F

        times = [[(100_000,)], [(200_000,)], [(300_000,)], [(1,), (300_001,)]]
        stream = _stream(spark, tmp_path, times, "s long").withColumn("ts", F.timestamp_seconds("s")).withWatermark("ts", "10 seconds").groupBy(F.window("ts", "1 minute")).count()
        query = stream.writeStream.format("memory").queryName("watched").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        deadline = time.time() + 20
        while time.time() < deadline:
            time.sleep(1)
            try:
                rows = progress.read_progress(spark, path).collect()
            except Exception:
                continue
            if any(r.event == "ended" for r in rows):
                break
    finally:
        spark.streams.removeListener(listener)
    told = [r for r in rows if r.event == "progress"]
    assert {r.event for r in rows} == {"started", "progress", "ended"} and sum(r.rows for r in told) == 5
    assert sum(r.late_rows for r in told) == 1 and any(r.watermark and r.watermark > "1970-01-02" for r in told) and max(r.state_rows for r in told) >= 1
