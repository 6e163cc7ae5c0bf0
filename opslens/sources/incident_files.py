"""Incident bundles: folders with details as JSON, incidents or events as CSV; and what a run writes of its tables.

CSV files have a header, hold text only and may begin with a byte order mark; JSON files hold one incident or a list. A cell
that is missing, null or empty falls back as its function says. Rows of a bundle are read in parts; only where a file has no
ids of its own are rows numbered, by the counts of the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text_rules

# Files of a bundle in the order in which they are taken.
DETAILS, INCIDENTS, EVENTS = "incident_details.json", "incidents.csv", "events.csv"
SCHEMA = (
    "incident_id string, detected_window_start string, detected_window_end string, fault_start string, fault_end string, primary_trace_id string, root_service_candidate string, "
    "root_cause_candidate string, root_error_timestamp string, services array<string>, trace_ids array<string>"
)
TEXTS = [x.split(" ")[0] for x in SCHEMA.split(", ") if x.endswith(" string")]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as text, without a byte order mark, null as empty."""
    rows = spark.read.option("recursiveFileLookup", True).csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    clean = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in rows.columns]
    return rows.select(*clean)


def _cell(columns, *names: str) -> Column:
    """The first of the named cells that is not empty."""
    return F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names if n in columns), F.lit(""))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with _n, counted from 1 in the order in which they are read."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    parts = rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(F.broadcast(parts), "_part").withColumn("_n", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def from_incidents(rows: DataFrame) -> DataFrame:
    """Details of the rows of an incidents file; a row without an id is named after its place."""
    cell = lambda *names: _cell(rows.columns, *names)
    counted = _numbered(rows)
    either = {"detected_window_start": "start", "detected_window_end": "end", "fault_start": "start", "fault_end": "end"}
    own = F.coalesce(F.when(cell("incident_id") != "", cell("incident_id")), F.concat(F.lit("I"), F.lpad(F.col("_n").cast("string"), 5, "0")))
    said = [cell(c, *filter(None, [either.get(c)])).alias(c) for c in TEXTS[1:]]
    return counted.select(own.alias("incident_id"), *said, *(text_rules.listed(cell(c)).alias(c) for c in ("services", "trace_ids")))


def from_events(rows: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The one incident that an events file tells of, and its timeline; neither has rows where no event is an error.

    The first error is the root. The timeline are the events of its trace, else the first errors."""
    cell = lambda *names: _cell(rows.columns, *names)
    told = _numbered(rows).select(
        F.col("_n").alias("place"), F.upper(cell("level")).alias("level"), cell("timestamp").alias("timestamp"), cell("service").alias("service"), cell("trace_id").alias("trace_id"),
        cell("message").alias("message"), cell("root_cause", "semantic_message", "message").alias("cause"),
    )
    errors = told.filter("level = 'ERROR'")
    root = errors.agg(F.min_by(F.struct(*told.columns), "place").alias("root")).filter("root is not null")
    same = told.join(F.broadcast(root.select(F.col("root.trace_id").alias("trace_id")).filter("trace_id <> ''")), "trace_id", "left_semi").select(told.columns)
    alone = F.broadcast(root.filter("root.trace_id = ''").select(F.lit("ERROR").alias("level")))
    timeline = same.unionByName(errors.orderBy("place").limit(most).join(alone, "level", "left_semi").select(told.columns))
    over = timeline.agg(
        F.min_by("timestamp", "place").alias("fault_start"), F.max_by("timestamp", "place").alias("fault_end"), F.sort_array(F.collect_set(F.when(F.col("service") != "", F.col("service")))).alias("services"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 0")
    r = lambda c: F.col(f"root.{c}")
    detail = F.broadcast(root).crossJoin(over).select(
        F.lit("I00001").alias("incident_id"), r("timestamp").alias("detected_window_start"), r("timestamp").alias("detected_window_end"), "fault_start", "fault_end", r("trace_id").alias("primary_trace_id"),
        r("service").alias("root_service_candidate"), r("cause").alias("root_cause_candidate"), r("timestamp").alias("root_error_timestamp"), "services", F.when(r("trace_id") != "", F.array(r("trace_id"))).otherwise(F.array().cast("array<string>")).alias("trace_ids"),
    )
    return detail, timeline.drop("cause")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Details of JSON files, absent fields as empty."""
    rows = spark.read.option("recursiveFileLookup", True).schema(SCHEMA).json(path, multiLine=True)
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in TEXTS), *(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("services", "trace_ids")))


def namespaced(details: DataFrame, prefix: str) -> DataFrame:
    """The details with ids under a prefix and source_incident_id, what they were called before; an empty prefix changes nothing."""
    own = F.when(F.col("incident_id") != "", F.col("incident_id")).otherwise("I00000")
    return details.withColumn("source_incident_id", own).withColumn("incident_id", F.concat(F.lit(f"{prefix}:"), own)) if prefix else details


def _names(spark: SparkSession, folder: str) -> set[str]:
    """Which files of a bundle there are under a folder: at most three names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return {r.name for r in files.filter(F.col("name").isin(DETAILS, INCIDENTS, EVENTS)).distinct().collect()}


def read_bundle(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Details of the incidents of a folder: of its details file, else its incidents, else its events.

    A file without incidents gives way to the next; a folder with none at all is refused."""
    there = _names(spark, folder)
    ways = ((DETAILS, lambda p: read_details(spark, p)), (INCIDENTS, lambda p: from_incidents(read_csv(spark, p))), (EVENTS, lambda p: from_events(read_csv(spark, p))[0]))
    for name, read in ways:
        if name in there:
            found = read(_matching(spark, folder, name))
            if not found.isEmpty():
                return namespaced(found, prefix)
    raise ValueError(f"{folder} holds no incidents in {DETAILS}, {INCIDENTS} or {EVENTS}")


def _matching(spark: SparkSession, folder: str, name: str) -> str:
    """The path of the file of that name, the least one of several."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    return files.agg(F.min("path").alias("path")).first().path


def write_artifacts(tables: dict[str, DataFrame], folder: str, csv: tuple[str, ...] = ()) -> None:
    """Each table in a folder of its own name: as Parquet, and those in `csv` as CSV with a header, times as text and lists as JSON.

    Tables stay in the parts that Spark has them in."""
    for name, rows in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        if name not in csv:
            rows.write.mode("overwrite").parquet(target)
            continue
        text = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]
        rows.select(*text).write.mode("overwrite").csv(target, header=True, escape='"', encoding="UTF-8")


def run_report(counts: DataFrame) -> str:
    """Markdown of one row of counts, such as run_summary(): a title and a line for each column."""
    row = counts.first().asDict()
    return "\n".join(["# Run report", "", *(f"- {name.replace('_', ' ')}: {value}" for name, value in row.items()), ""])


def analysis_report(hypotheses: DataFrame, most: int = 3) -> DataFrame:
    """incident, text: for each incident Markdown of its first hypotheses (incident, rank, candidate, fault_mode, score, status)."""
    line = F.format_string("%d. %s — %s (%.3f, %s)", F.col("rank").cast("long"), "candidate", F.coalesce("fault_mode", F.lit("")), F.col("score").cast("double"), "status")
    found = hypotheses.filter(F.col("rank") <= most).groupBy("incident").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return found.select("incident", F.concat_ws("\n", F.concat(F.lit("## "), "incident"), F.lit(""), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("text"))
