"""Progress of streams as rows: one for each batch of each query, appended to a table in a shared folder."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query_id string, run_id string, name string, batch_id long, event string, at string, rows long, rows_per_second double, watermark string, state_rows long, late_rows long, millis long"


class ProgressTable(StreamingQueryListener):
    """Writes what happens to the session's streams. late_rows: rows that Spark dropped behind its watermark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, threading.Lock()

    def _put(self, *row) -> None:
        with self.lock:
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        self._put(str(event.id), str(event.runId), event.name, None, "started", event.timestamp, None, None, None, None, None, None)

    def onQueryProgress(self, event):
        p = event.progress
        state = p.stateOperators
        self._put(
            str(p.id), str(p.runId), p.name, p.batchId, "progress", p.timestamp, p.numInputRows, float(p.processedRowsPerSecond), (p.eventTime or {}).get("watermark"),
            sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state), int(p.batchDuration),
        )

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._put(str(event.id), str(event.runId), None, None, "failed" if event.exception else "ended", None, None, None, None, None, None, None)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a ProgressTable has written; the share of late rows is told beside all rows."""
    return spark.read.schema(SCHEMA).parquet(path)
