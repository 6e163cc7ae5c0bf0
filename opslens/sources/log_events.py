"""Log events: from raw log files, or from the shared `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text_rules
from . import log_files
from .log_files import MAX_BYTES, MAX_MEMBERS

# The grammar of a log line, of trace ids, of targets and of exception lines.
HEADER = r"^((?:\d{2}/\d{2}/\d{2}|\d{4}[-/]\d{2}[-/]\d{2})\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+---\s+\[([^\]]+)\]\s+(.*?)\s*:\s*(.*)$"
TRACE_PREFIX = r"^\[([A-Za-z0-9_.-]{4,64})\]\s*(.*)$"
INLINE_TRACE = r"(?i)\b(?:trace_?id|request_?id|req_?id|uuid|span_?id|correlation_?id)\s*[=:]\s*['\"]?([A-Za-z0-9_.-]{4,64})['\"]?"
DOWNSTREAM = r"(?i)\b(?:downstream|target\s+physical\s+host|target\s+host|target_?service|calling\s+downstream\s+service)\s*[=:]\s*['\"]?([A-Za-z0-9_.-]{2,64})['\"]?"
CLASS = r"([A-Za-z_$][\w.$]*(?:Exception|Error))\b"
EXCEPTION_HEADER = r"(?i)^(?:(Caused by|Suppressed)\s*:\s*)?([A-Za-z_$][\w.$]*(?:Exception|Error))(?::\s*(.*))?$"
FORMATS = ("yy/MM/dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss.SSS")

#: Log fields derived from the events table; the same text runs in Spark and DuckDB, apart from the seconds.
ADAPTER = """
SELECT event_id, {seconds} AS event_s, user_id, value,
 CASE WHEN event_type = 'error' AND value >= 150 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
      WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
 'svc-' || CAST(user_id % 6 AS STRING) AS service,
 'node-' || CAST(user_id % 3 AS STRING) AS instance,
 CASE WHEN user_id % 4 = 0 THEN '' ELSE 'tr-' || CAST(CAST(floor(event_id / 5) AS BIGINT) AS STRING) END AS trace_id,
 CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10
   WHEN 0 THEN 'io.lettuce.core.RedisCommandTimeoutException: Command timed out after 20 seconds'
   WHEN 1 THEN 'RedisConnectionException: Unable to connect to redis-2:6379; connection refused'
   WHEN 2 THEN 'Deadlock found when trying to get lock; try restarting transaction'
   WHEN 3 THEN 'HikariPool-1 - Connection is not available, request timed out after 30000ms'
   WHEN 4 THEN '502 Bad Gateway calling downstream=svc-1'
   WHEN 5 THEN 'java.lang.OutOfMemoryError: Java heap space'
   WHEN 6 THEN 'password mismatch for user ' || CAST(user_id AS STRING)
   WHEN 7 THEN 'rabbitmq channel closed: AlreadyClosedException'
   WHEN 8 THEN 'retrying request ' || CAST(event_id AS STRING) || ' with backoff'
   ELSE 'GET /orders/' || CAST(event_id AS STRING) || ' from 10.0.2.' || CAST(user_id % 250 AS STRING)
        || ' took ' || CAST(user_id AS STRING) || 'ms' END AS message
FROM {events}"""
SPARK_SECONDS = "unix_seconds(CAST(ts AS TIMESTAMP))"
DUCK_EVENTS = ADAPTER.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)", events="events")


def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_s (seconds since 1970), user_id, value, level, service, instance, trace_id, message, and both exception classes.

    A message is one line, so the first class that it names is the exception's and the root's."""
    rows = spark.sql(ADAPTER.format(seconds=SPARK_SECONDS, events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    named = F.regexp_extract("message", CLASS, 1)
    return rows.withColumns({"exception_class": named, "root_exception_class": named})


def event_time(text: Column) -> Column:
    """The time of a header in one of the formats; null where none fits."""
    text = F.regexp_replace(text, r"\s+", " ")
    zoneless = lambda f: F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
    return F.coalesce(
        F.when(text.rlike(r"^\d{2}/"), zoneless(FORMATS[0])), F.when(text.rlike(r"^\d{4}-"), zoneless(FORMATS[1])), F.when(text.rlike(r"^\d{4}/"), zoneless(FORMATS[2]))
    )


def exception_entry(line: Column, first: bool = False) -> Column:
    """What an exception line says as (kind, class, message), null for other lines.

    A line is an exception's header as a whole; the first message, lines that begin with Caused by or Suppressed, and those
    that say "exception is" may also hold a class anywhere."""
    line = F.trim(line)
    part = lambda i: F.regexp_extract(line, EXCEPTION_HEADER, i)
    kind = lambda said: F.when(F.lower(said).startswith("caused by"), "caused_by").when(F.lower(said).startswith("suppressed"), "suppressed").otherwise("direct")
    entry = lambda k, c, m: F.struct(k.alias("kind"), c.alias("class"), m.alias("message"))
    loose = F.regexp_extract(line, CLASS, 1)
    eligible = F.lit(first) | F.lower(line).rlike("^(caused by:|suppressed:)|exception is")
    rest = F.regexp_extract(line, CLASS + r"[: ]*(.*)$", 2)
    skipped = (line == "") | line.startswith("at ") | line.startswith("... ")
    return F.when(~skipped, F.when(line.rlike(EXCEPTION_HEADER), entry(kind(part(1)), part(2), part(3))).when(eligible & (loose != ""), entry(kind(line), loose, rest)))


def with_exceptions(events: DataFrame) -> DataFrame:
    """The events (message, tail: array of further lines) with exception_class, root_exception_class, root_cause and
    exception_chain: suppressed entries count only where there are no others; the root is the last cause, else the last entry."""
    entries = F.concat(F.array(exception_entry(F.col("message"), True)), F.transform("tail", lambda line: exception_entry(line)))
    found = events.withColumn("_all", F.filter(entries, lambda e: e.isNotNull()))
    open_ = F.filter("_all", lambda e: e["kind"] != "suppressed")
    found = found.withColumn("_some", F.when(F.size(open_) > 0, open_).otherwise(F.col("_all")))
    causes = F.filter("_some", lambda e: e["kind"] == "caused_by")
    found = found.withColumn("_root", F.coalesce(F.try_element_at(causes, F.lit(-1)), F.try_element_at("_some", F.lit(-1))))
    root = F.regexp_replace(F.concat(F.col("_root")["class"], F.lit(": "), F.col("_root")["message"]), "[: ]+$", "")
    return found.select(
        *events.columns, F.coalesce(F.get("_some", F.lit(0))["class"], F.lit("")).alias("exception_class"), F.coalesce(F.col("_root")["class"], F.lit("")).alias("root_exception_class"),
        F.coalesce(root, F.lit("")).alias("root_cause"), F.to_json("_all").alias("exception_chain"),
    )


def text_lines(spark: SparkSession, path: str, include=("*.log",), exclude=("*-err.log", "*-debug.log"), **options) -> DataFrame:
    """source_file, part, line, text of the lines of all files under a folder whose names match, lines counted from 1.

    Files are read in ranges of bytes. Lines of a part are numbered as they are read; only the parts' line counts are summed
    up in the order of a file. options: encoding, errors and rangeBytes of the source."""
    rows = log_files.load(spark, path, include=include, exclude=exclude, **options)
    parts = rows.groupBy("source_file", "part").agg(F.max("line").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(parts, ["source_file", "part"]).select("source_file", "part", (F.col("_before") + F.col("line")).alias("line"), "text")


def zip_lines(spark: SparkSession, path: str, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """source_file (member), part, line, text of the .log and .txt members of zip files, a task a member; nothing is unpacked to disk.

    A zip file with a member of another kind, a path that leads out, too many members or bytes, or one that shrinks too much
    is refused as a whole, before any of it is read."""
    return log_files.load(spark, path, kind="zip", maxMembers=max_members, maxBytes=max_bytes, **options).select("source_file", "part", "line", "text")


def precheck(spark: SparkSession, path: str, include=("*.log", "*.txt"), exclude=(), **options) -> DataFrame:
    """name, n of the files under a folder before they are analysed: lines, header_lines, unparsed_times (headers whose time fits
    no format), files, and a row `level <name>` a level."""
    rows = log_files.load(spark, path, include=include, exclude=exclude, **options)
    stamp = event_time(F.regexp_extract("text", HEADER, 1))
    head = F.col("text").rlike(HEADER)
    counted = rows.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.count_if(head).alias("headers"), F.count_if(head & stamp.isNull()).alias("unparsed"))
    # A row a level.
    listed = lambda name, n: F.struct(name.alias("name"), n.cast("long").alias("n"))
    sums = counted.select(F.explode(F.array(listed(F.lit("lines"), F.col("lines")), listed(F.lit("header_lines"), F.col("headers")), listed(F.lit("unparsed_times"), F.col("unparsed")), listed(F.concat(F.lit("level "), "level"), F.col("lines")))).alias("x"))
    files = rows.agg(F.count_distinct("source_file").alias("n")).select(F.lit("files").alias("name"), "n")
    return sums.select("x.*").filter("name is not null").groupBy("name").agg(F.sum("n").alias("n")).unionByName(files)


def assemble(lines: DataFrame) -> DataFrame:
    """Events from lines (source_file, part, line, text), one row per header line.

    Lines that are no header belong to the last header before them, and lines before a file's first header are dropped. The
    last header is looked for within a part; what a part begins with takes the last header of the parts before it."""
    heads = lines.withColumn("_head", F.when(F.col("text").rlike(HEADER), F.col("line")))
    parts = heads.groupBy("source_file", "part").agg(F.max("_head").alias("_last"))
    before = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carried", F.max("_last").over(before)).drop("_last")
    within = Window.partitionBy("source_file", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = heads.withColumn("source_line", F.max("_head").over(within)).join(parts, ["source_file", "part"])
    owned = owned.withColumn("source_line", F.coalesce("source_line", "_carried")).filter("source_line is not null")
    events = owned.groupBy("source_file", "source_line").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("block"))
    part = lambda i: F.regexp_extract(F.col("block")[0], HEADER, i)
    events = events.select("source_file", "source_line", "block", part(1).alias("_stamp"), *(part(i).alias(n) for i, n in ((2, "level"), (3, "thread"), (4, "logger"), (5, "_said"))))
    prefixed = F.col("_said").rlike(TRACE_PREFIX)
    events = events.withColumns({
        "message": F.when(prefixed, F.regexp_extract("_said", TRACE_PREFIX, 2)).otherwise(F.col("_said")),
        "raw_block": F.array_join("block", "\n"), "tail": F.slice("block", 2, F.greatest(F.size("block"), F.lit(1))),
    })
    whole = F.concat_ws("\n", "message", F.array_join("tail", "\n"))
    events = events.withColumns({
        "trace_id": F.when(prefixed, F.regexp_extract("_said", TRACE_PREFIX, 1)).otherwise(F.regexp_extract(whole, INLINE_TRACE, 1)), "downstream": F.regexp_extract(whole, DOWNSTREAM, 1),
    })
    name = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.(log|txt)$", "")
    service = F.regexp_replace(F.regexp_replace(name, "-(err|debug)$", ""), r"-\d+$", "")
    folder = F.coalesce(F.try_element_at(F.split("source_file", "/"), F.lit(-2)), F.lit(""))
    return with_exceptions(events).select(
        F.concat_ws(":", "source_file", F.col("source_line").cast("string")).alias("event_id"), event_time(F.col("_stamp")).alias("event_ts"), "level", "thread", "logger", "message",
        "trace_id", "downstream", F.coalesce(F.when(service != "", service), folder).alias("service"), folder.alias("instance"), "exception_class", "root_exception_class", "root_cause", "exception_chain",
        text_rules.semantic_message(F.col("message"), F.col("exception_class"), F.col("root_cause")).alias("semantic_message"), "raw_block", "source_file", "source_line",
    )


def read_logs(spark: SparkSession, path: str, include=("*.log",), exclude=("*-err.log", "*-debug.log"), **options) -> DataFrame:
    """Multi-line log events of all files under a folder."""
    return assemble(text_lines(spark, path, include, exclude, **options))


def read_zips(spark: SparkSession, path: str, **limits) -> DataFrame:
    """Multi-line log events of the members of all zip files under a folder."""
    return assemble(zip_lines(spark, path, **limits))
