"""Scalar functions over log messages, all as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fault families in order, each by the substrings that name it.
FAMILIES = (
    ("memory", ("outofmemory", "heap space", "metaspace", "gc overhead")),
    ("disk", ("read-only file system", "ioexception", "disk")),
    ("hardware", ("nic link down", "hardware host crash", "cpu load")),
    ("mq", ("rabbitmq", "kafka", "rocketmq", "amqp", "alreadyclosedexception")),
    ("redis", ("redis", "jedis", "lettuce")),
    ("database", ("sql", "jdbc", "hikari", "mysql", "postgres", "oracle", "database", "communications", "deadlock")),
    ("classloading", ("classformat", "verifyerror", "noclassdeffound", "classnotfound", "linkageerror")),
    ("network", ("socket", "connectexception", "unknownhost", "transportexception", "connection reset", "connection refused")),
    ("timeout", ("timeout", "timed out")),
    ("authentication", ("license", "password", "authentication", "authorization", "accessdenied", "401")),
    ("business", ("business", "illegalargument", "illegalstate")),
)
# Families that count as technical faults, and substrings that name a root cause or a passed-on error.
TECHNICAL = ("redis", "database", "network", "timeout", "classloading", "memory", "disk", "hardware", "mq")
ATOMIC = (
    "rediscommandtimeoutexception", "redisconnectionexception", "jedisclusterexception", "rediscommandexecutionexception", "communications exception",
    "communicationsexception", "deadlock", "mysqltransactionrollbackexception", "lock wait timeout", "sqltransientconnectionexception",
    "sqlintegrityconstraintviolationexception", "hikaripool", "connection refused", "connection reset", "read timed out", "unknownhostexception",
    "outofmemoryerror", "java heap space", "read-only file system", "alreadyclosedexception", "nic link down", "cpu load", "hardware host crash",
)
WRAPPER = (
    "bad gateway", "downstreamserviceexception", "downstream call", "downstream service", "gateway error", "proxyfilter", "http 500", "http 502", "http 504",
    "500 internal server error", "504 gateway time-out",
)
# What masking replaces, in order.
MASKS = (
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    r"(?i)\b(?:[0-9a-f]{8,})\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b\d+ms\b",
    r"\b\d+(?:\.\d+)?\b",
)
# Placeholders of normalised patterns, in order.
PATTERNS = (
    (r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}[T\s]\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"(?i)\b(?:0x)?[0-9a-f]{12,}\b", "<hex>"),
    (r"([=:]\s*)['\"]?[A-Za-z0-9_.:/-]{8,}['\"]?", "$1<id>"),
    (r"(?i)(?<![A-Za-z_])[-+]?\d+(?:\.\d+)?(?:ms|s|m|h|kb|mb|gb|%)?(?![A-Za-z_])", "<num>"),
)
# Weights of levels, and signals with their weights.
LEVEL_WEIGHT = {"FATAL": 13.0, "CRITICAL": 13.0, "ERROR": 10.0, "WARN": 6.0, "WARNING": 6.0, "INFO": 1.5, "DEBUG": 0.4, "TRACE": 0.1}
SIGNALS = (
    ("outofmemory|oom|java heap space|metaspace", 10.0),
    ("deadlock|lock wait timeout", 9.0),
    ("connection refused|connection reset|broken pipe|no route to host", 8.0),
    ("rediscommandtimeoutexception|redisconnectionexception", 8.0),
    ("sqltransientconnectionexception|communicationsexception|hikaripool", 8.0),
    ("timeout|timed out|deadline exceeded", 6.0),
    ("circuit.?breaker.*open|service unavailable|bad gateway|gateway timeout", 5.0),
    (r"exception|\berror\b|failed|failure|panic|fatal", 4.0),
    ("retry(?:ing)?|backoff|degraded|fallback", 2.0),
)


def any_of(words) -> str:
    """One alternation for a list of plain substrings."""
    return "|".join(re.sub(r"([.()\[\]+*?|\\])", r"\\\1", w) for w in words)


#: What a class name of a passed-on error holds.
WRAPPER_CLASSES = ("downstreamserviceexception", "gateway", "proxyfilter")
#: Columns whose text tells of a fault, in order.
TEXTS = ("message", "semantic_message", "root_cause", "raw_block")


def event_text(columns, prefix: Column | None = None) -> Column:
    """The lowered text of an event: those of TEXTS that it has, null as empty."""
    return F.lower(F.concat_ws(" ", *([prefix] if prefix is not None else []), *(F.coalesce(F.col(c), F.lit("")) for c in TEXTS if c in columns)))


def class_name(columns) -> Column:
    """The lowered class of the root cause, else of the exception, else empty."""
    known = [F.when(F.col(c) != "", F.lower(F.col(c))) for c in ("root_exception_class", "exception_class") if c in columns]
    return F.coalesce(*known, F.lit(""))


def fault_family(text: Column, named: Column | None = None) -> Column:
    """The first family whose words a text holds; else the class that is named, else unknown."""
    text, out = F.lower(text), F.when(F.lit(False), F.lit(""))
    for name, words in FAMILIES:
        out = out.when(text.rlike(any_of(words)), F.lit(name))
    return out.when(named != "", named).otherwise(F.lit("unknown")) if named is not None else out.otherwise(F.lit("unknown"))


def is_error(level: Column) -> Column:
    return F.upper(level).isin("ERROR", "FATAL")


def is_atomic(text: Column) -> Column:
    return F.lower(text).rlike(any_of(ATOMIC))


def is_wrapper(text: Column, named: Column | None = None) -> Column:
    held = F.lower(text).rlike(any_of(WRAPPER))
    return held if named is None else held | named.rlike(any_of(WRAPPER_CLASSES))


def mask(message: Column) -> Column:
    for pattern in MASKS:
        message = F.regexp_replace(message, pattern, "<*>")
    return F.trim(F.regexp_replace(message, r"\s+", " "))


def normalise_pattern(message: Column) -> Column:
    text = F.lower(message)
    for pattern, shown in PATTERNS:
        text = F.regexp_replace(text, pattern, shown)
    text = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 500)
    return F.when(text == "", F.lit("<empty>")).otherwise(text)


def signal_weight(message: Column) -> Column:
    return sum((F.when(message.rlike(f"(?i){p}"), w).otherwise(0.0) for p, w in SIGNALS), F.lit(0.0))


def level_weight(level: Column) -> Column:
    """The weight of a level; 1 for one that is not known."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in LEVEL_WEIGHT.items():
        out = out.when(F.upper(level) == name, F.lit(weight))
    return out.otherwise(F.lit(1.0))


def flagged(events: DataFrame) -> DataFrame:
    """The events with family, is_error, is_technical, is_atomic, is_wrapper, told by all texts and class names that they have."""
    named, text, level = class_name(events.columns), event_text(events.columns), F.col("level")
    both = F.concat_ws(" ", named, text)
    found = events.select("*", fault_family(both, named).alias("family"), is_error(level).alias("is_error"), is_atomic(text).alias("is_atomic"), is_wrapper(both, named).alias("is_wrapper"))
    return found.withColumn("is_technical", F.col("is_error") & (F.col("family").isin(*TECHNICAL) | F.col("is_atomic")))
