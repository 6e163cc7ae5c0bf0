"""Scalar rules over log texts, names, lists and endpoints, all as Spark expressions.

Null counts as empty unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import log_text

# Words that are no evidence, endings of service names, and separators of lists.
STOP_WORDS = ("error", "exception", "failed", "failure", "日志", "故障", "服务", "原因", "发生")
EVIDENCE = r"[A-Za-z][A-Za-z0-9_.-]{3,}|[一-鿿]{2,}"
NAME_ENDING = r"(?:service|server|svc|服务|应用|模块|系统)$"
NOT_NAME = r"[^a-z0-9一-龥]"
LIST_CUTS = "[,，;；]"
# What endpoints look like in logs.
IP_PORT = r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b"
HOST_PORT = r"\b[a-zA-Z][a-zA-Z0-9_.-]{1,80}:\d{2,5}\b"
KEYED_HOST = r"(?i)\b(?:host|hostname|node|instance|endpoint|server|redis)\s*[=:]\s*([a-z0-9_.-]+(?::\d{2,5})?)"
# Keys of node metadata that identify a node.
IDENTIFIERS = ("alias", "aliases", "service", "service_name", "service_names", "instance", "instance_id", "host", "hostname", "ip", "endpoint", "endpoints")
# Labels of fault modes by key.
FAULT_LABELS = {
    "REDIS_CLUSTER_DOWN": "Redis 集群不可用",
    "CLUSTERDOWN": "Redis 集群不可用",
    "REDIS_TIMEOUT": "Redis 访问超时",
    "CONNECTION_TIMEOUT": "下游连接超时",
    "TIMEOUT": "请求处理超时",
    "CONNECTION_REFUSED": "连接被拒绝",
    "HTTP_404": "接口资源不存在",
    "NOT_FOUND": "接口资源不存在",
    "APPLICATION_ERROR": "应用程序异常",
    "DATABASE_ERROR": "数据库访问异常",
}
MESSAGES = ("root_cause", "semantic_message", "message", "raw_block", "description")


def string(value: Column) -> Column:
    """The value as text, null and NaN as empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "NaN", F.lit("")).otherwise(text)


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def first_said(*texts: Column) -> Column:
    """The first text that is not blank, with single spaces; else empty."""
    return F.coalesce(*(F.when(F.trim(t) != "", spaced(t)) for t in texts), F.lit(""))


def event_message(columns) -> Column:
    """The first of an event's texts that is not blank."""
    return first_said(*(F.col(c) for c in MESSAGES if c in columns))


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    """The trimmed text; where it is longer than the limit, its beginning without spaces at its end, and the mark."""
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(1, limit - len(mark)))), F.lit(mark)))


def compact(text: Column, limit: int = 420) -> Column:
    """The text with single spaces; where it is longer than the limit, its beginning and three dots."""
    text = spaced(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def semantic_message(message: Column, exception_class: Column, root_cause: Column) -> Column:
    """The message with the class and the root cause where it doesn't hold them, joined by bars."""
    adds_class = (exception_class != "") & ~F.contains(message, exception_class)
    adds_cause = (root_cause != "") & ~F.contains(message, root_cause) & (root_cause != exception_class)
    return F.concat_ws(" | ", F.when(message != "", message), F.when(adds_class, exception_class), F.when(adds_cause, root_cause))


def signature(columns) -> Column:
    """service|LEVEL|template id or normalised pattern of the template or message."""
    has = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) if c in columns else F.lit(None).cast("string")
    level = F.upper(F.coalesce(has("level"), has("severity"), F.lit("INFO")))
    level = F.when(level == "WARNING", F.lit("WARN")).otherwise(level)
    named = F.coalesce(has("template_id"), log_text.normalise_pattern(F.coalesce(has("template"), event_message(columns))))
    return F.concat_ws("|", F.coalesce(has("service"), F.lit("")), level, named)


def pattern_key(service: Column, level: Column, template_id: Column, message: Column) -> Column:
    """service|LEVEL|template:<id>, or the message with UUIDs, addresses and numbers masked, cut at 320."""
    text = F.lower(spaced(message))
    for pattern, shown in ((log_text.PATTERNS[1][0], "<uuid>"), (log_text.PATTERNS[2][0], "<ip>"), (r"\b\d+\b", "<num>")):
        text = F.regexp_replace(text, pattern, shown)
    named = F.when(F.coalesce(template_id, F.lit("")) != "", F.concat(F.lit("template:"), template_id)).otherwise(F.substring(text, 1, 320))
    return F.concat_ws("|", F.coalesce(service, F.lit("")), F.upper(F.coalesce(level, F.lit(""))), named)


def evidence_tokens(text: Column) -> Column:
    """The distinct words of a text that may be evidence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(EVIDENCE), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def token_similarity(left: Column, right: Column) -> Column:
    """The share of equal or masked places of two token lists; 0 for lists of different or no length."""
    alike = F.size(F.filter(F.zip_with(left, right, lambda a, b: (a == b) | (a == "<*>") | (b == "<*>")), lambda x: x))
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), alike / F.size(left)).otherwise(F.lit(0.0))


def merge_templates(left: Column, right: Column) -> Column:
    """The token list with a mask where two lists differ."""
    return F.zip_with(left, right, lambda a, b: F.when(a == b, a).otherwise(F.lit("<*>")))


def feature_name(service: Column, template: Column, level: Column | None = None) -> Column:
    return F.concat_ws("::", service, template, *([level] if level is not None else []))


def entity_name(name: Column) -> Column:
    """A name without its ending and signs, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), NAME_ENDING, ""), NOT_NAME, "")


def listed(value: Column) -> Column:
    """The items of a cell that holds a JSON list or text cut by commas or semicolons; blank ones go."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    plain = F.transform(F.split(text, LIST_CUTS), lambda x: F.trim(x))
    return F.filter(F.coalesce(F.when(F.size(parsed) >= 0, parsed), plain), lambda x: x.isNotNull() & (F.trim(x) != ""))


def identifiers(name: Column, meta: Column) -> Column:
    """The lowered names of a node: its own, those of its metadata, and each host with each port."""
    hosts = listed(F.coalesce(meta["host"], meta["hostname"], meta["ip"]))
    ports = listed(F.coalesce(meta["port"], meta["ports"]))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(ports, lambda p: F.concat(h, F.lit(":"), p))))
    every = F.concat(F.array(name), *(listed(meta[k]) for k in IDENTIFIERS), pairs)
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(F.lower(x))), lambda x: x != ""))


def endpoint_tokens(text: Column) -> Column:
    """The addresses, host:port pairs and keyed hosts that a text names, lowered and sorted."""
    every = lambda pattern, group: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))
    pairs = F.filter(every(HOST_PORT, 0), lambda x: ~F.lower(x).rlike(r"^https?:\d+$"))
    return F.array_sort(F.array_distinct(F.transform(F.concat(every(IP_PORT, 0), pairs, every(KEYED_HOST, 1)), lambda x: F.lower(x))))


def ip_addresses(text: Column, most: int = 24) -> Column:
    """The first valid IPv4 addresses of a text, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))
    valid = F.filter(found, lambda x: F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255))
    return F.slice(F.array_distinct(valid), 1, most)


def safe_endpoint(value: Column) -> Column:
    """An endpoint without user, query and fragment."""
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[?#].*$", "")
    return F.regexp_replace(text, r"^(\w+://)?[^/@]*@", "$1")


def redacted(text: Column, limit: int) -> Column:
    """The text with the values of secret names replaced, cut at the limit."""
    said = F.regexp_replace(spaced(text), r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[^\s,;，；]+", "$1=<redacted>")
    return F.substring(said, 1, limit)


def steps(text: Column, most: int = 8, limit: int = 500) -> Column:
    """The distinct items of a text cut by lines and semicolons, without bullets and numbers."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "[\n；;]"), lambda x: F.substring(F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*•]+|\d+[.)、])\s*", "")), 1, limit))
    return F.slice(F.array_distinct(F.filter(items, lambda x: x != "")), 1, most)


def fault_label(raw: Column) -> Column:
    """The label of a fault mode: by its key, then by what the key holds, else as it is."""
    raw = F.coalesce(raw, F.lit(""))
    key = F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(key == "", F.lit("未分类故障"))
    for name, label in FAULT_LABELS.items():
        out = out.when(key == name, F.lit(label))
    out = out.when(F.contains(key, F.lit("REDIS")) & (F.contains(key, F.lit("DOWN")) | F.contains(key, F.lit("CLUSTER"))), F.lit("Redis 集群不可用"))
    out = out.when(F.contains(key, F.lit("TIMEOUT")), F.lit("请求或连接超时")).when(F.contains(key, F.lit("404")) | F.contains(key, F.lit("NOT_FOUND")), F.lit("接口资源不存在"))
    return out.when(F.contains(key, F.lit("CONNECT")), F.lit("连接异常")).otherwise(F.trim(raw))


def chain(value: Column) -> Column:
    """The nodes of a chain cell: a JSON list, or names joined by arrows."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(F.when(F.size(parsed) >= 0, parsed), F.split(text, "->")), lambda x: F.trim(x)), lambda x: x != "")


def exception_node(root_cause: Column) -> Column:
    """Exception:<class> of a root cause, or its first 48 characters."""
    found = F.regexp_extract(root_cause, r"([A-Za-z_$][\w.$]*(?:Exception|Error))\b", 1)
    return F.concat(F.lit("Exception:"), F.when(found != "", found).otherwise(F.substring(root_cause, 1, 48)))


def project_and_name(name: Column) -> tuple[Column, Column]:
    """The project and the shown name of project::<id>::<name>; other names have no project."""
    parts = F.split(name, "::", 3)
    scoped = (F.get(parts, F.lit(0)) == "project") & (F.size(parts) == 3)
    return F.when(scoped, F.get(parts, F.lit(1))).otherwise(F.lit("")), F.when(scoped, F.get(parts, F.lit(2))).otherwise(name)


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "critical").when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")
