"""Rules on texts and metadata that describe an architecture, as Spark expressions; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_rules

# The layer of each kind of node, what names of kinds look like, and the layer and kind of what is not known.
LAYERS = {
    "System": "系统层", "Layer": "系统层", "Service": "业务服务层", "Database": "数据层", "Cache": "数据层", "Cluster": "基础设施层", "Instance": "基础设施层",
    "Host": "基础设施层", "Pod": "基础设施层", "Queue": "中间件层", "Middleware": "中间件层", "API": "网关层", "Function": "功能层",
}
INSTANCE = r"(?i)^redis(?:[-_](?:node[-_]?)?|节点[-_]?)\d+$"
QUEUE = "(?i)Kafka|RabbitMQ|RocketMQ|MQ|消息队列"
MIDDLEWARE = "(?i)Nacos|Consul|Etcd|ElasticSearch|Elasticsearch|ES|Zookeeper|ZooKeeper"
DEFAULT_LAYER, DEFAULT_KIND, DEFAULT_RELATION = "Component层", "Component", "CALLS"
# Metadata of a node that may be shown, each with the keys that it is taken from.
RUNTIME = (
    ("aliases", ("aliases", "alias", "raw_service")),
    ("hostnames", ("host", "hosts", "hostname", "hostnames")),
    ("ips", ("ip", "ips", "ip_address", "ip_addresses")),
    ("ports", ("port", "ports", "service_port", "target_port", "container_port")),
    ("endpoints", ("endpoint", "endpoints", "address", "addresses")),
    ("instance_ids", ("instance", "instance_id", "instanceId", "instance_ids")),
    ("service_names", ("service", "service_name", "serviceName", "application_name")),
    ("clusters", ("cluster", "cluster_name", "clusterName")),
    ("namespaces", ("namespace", "namespaces")),
    ("pods", ("pod", "pod_name", "podName", "pods")),
    ("protocols", ("protocol", "protocols", "scheme")),
    ("regions", ("region", "regions")),
    ("zones", ("zone", "availability_zone", "zones")),
    ("health_checks", ("health_check", "health_check_url", "health_url", "probe")),
)
SECRET = r"(?i)(?:password|passwd|token|secret|private[_-]?key|access[_-]?key)\s*[=:]"


def inferred_kind(name: Column) -> Column:
    """The kind that a name tells, by its ending or the product that it names."""
    name, low = F.coalesce(name, F.lit("")), F.lower(F.coalesce(name, F.lit("")))
    redis, ends = low.contains("redis"), lambda *words: low.rlike(f"(?:{'|'.join(words)})$")
    rules = (
        (ends("系统"), "System"), (ends("层"), "Layer"), (ends("服务"), "Service"), (ends("数据库", "db"), "Database"), (redis & low.rlike("集群|cluster"), "Cluster"), (name.rlike(INSTANCE), "Instance"),
        (redis | low.contains("memcached"), "Cache"), (ends("集群", "cluster"), "Cluster"), (ends("节点", "实例"), "Instance"), (name.rlike(QUEUE), "Queue"), (name.rlike(MIDDLEWARE), "Middleware"),
        (low.rlike("api|网关"), "API"), (ends("功能"), "Function"),
    )
    return F.coalesce(*(F.when(holds, F.lit(kind)) for holds, kind in rules), F.lit(DEFAULT_KIND))


def default_layer(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(layer)) for k, layer in LAYERS.items()), F.lit(DEFAULT_LAYER))


def chunks(text: Column, most: int) -> Column:
    """The text in pieces of whole paragraphs of at most `most` characters each; longer paragraphs are cut after sentences.

    A sentence that is longer by itself is a piece of its own. Blank texts give no pieces."""
    blank = lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")) == ""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(bare(F.coalesce(text, F.lit(""))), r"\n\s*\n"), bare), lambda x: x != "")
    cut = lambda p: F.when(F.length(p) > most, F.filter(F.split(p, r"(?<=[。；;\n])"), lambda s: ~blank(s))).otherwise(F.array(p))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))
    state = lambda done, now, n: F.struct(done.alias("done"), now.alias("open"), n.alias("n"))

    def step(s, x):
        n = F.length(x) + 1
        full = s["open"].isNotNull() & (s["n"] + n > most)
        return F.when(full, state(F.concat(s["done"], F.array(s["open"])), x, n)).otherwise(state(s["done"], F.concat_ws("\n", s["open"], x), s["n"] + n))

    every = F.aggregate(F.flatten(F.transform(paragraphs, cut)), start, step, lambda s: F.concat(s["done"], F.array(F.coalesce(s["open"], F.lit("")))))
    return F.filter(F.transform(every, bare), lambda x: x != "")


def runtime_meta(meta: Column, most: int = 8) -> Column:
    """Of a node's metadata (map of texts or JSON lists) what may be shown, as a map of lists.

    Values are told apart whatever their case; ports outside 1 to 65535, malformed addresses and values that hold a secret
    go, endpoints lose user, query and fragment, and each list keeps its first `most` values."""
    number = lambda x: x.try_cast("int")
    fields = []
    for field, keys in RUNTIME:
        values = F.transform(F.concat(*(text_rules.listed(meta[k]) for k in keys)), text_rules.spaced)
        if field == "ports":
            values = F.transform(F.filter(values, lambda x: number(x).between(1, 65535)), lambda x: number(x).cast("string"))
        elif field == "ips":
            values = F.filter(values, lambda x: x.rlike(r"^(?:(?:0|1?[1-9]?\d|1\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}$") & ~x.endswith(".") | x.rlike(r"^(?=.*:.*:)[0-9A-Fa-f:.]+$"))
        elif field in ("endpoints", "health_checks"):
            values = F.transform(values, text_rules.safe_endpoint)
        values = F.transform(F.filter(values, lambda x: (x != "") & ~x.rlike(SECRET)), lambda x: F.substring(x, 1, 300))
        fields.append(F.struct(F.lit(field).alias("key"), values.alias("value")))
    held = F.transform(F.array(*fields), lambda f: F.struct(f["key"].alias("key"), _distinct(f["value"], most).alias("value")))
    return F.map_from_entries(F.filter(held, lambda f: F.size(f["value"]) > 0))


def _distinct(values: Column, most: int) -> Column:
    low = F.transform(values, lambda x: F.lower(x))
    return F.slice(F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def flattened_checks(checks: Column, most: int = 8) -> Column:
    """Checks (structs with title, check_id, reason, manual_command_hint) as texts, without blank ones."""
    first = lambda *xs: F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in xs))
    said = F.transform(checks, lambda c: F.concat_ws("；", first(c["title"], c["check_id"]), first(c["reason"]), first(c["manual_command_hint"])))
    return F.slice(F.filter(said, lambda x: x != ""), 1, most)


_NODE = "name string, id string, label string, layer string, layer_type string, kind string, type string, description string, `desc` string"
_CALL = "source string, `from` string, `out` string, outV string, target string, `to` string, `in` string, inV string, type string, relation_type string, description string, `desc` string"
_ITEM = _NODE + ", " + ", ".join(x for x in _CALL.split(", ") if x.split(" ")[0] not in ("type", "description", "`desc`"))
_GRAPH = ", ".join(f"{n} array<struct<{_NODE}>>" for n in ("services", "nodes", "vertices")) + ", " + ", ".join(f"{n} array<struct<{_CALL}>>" for n in ("calls", "edges", "relations"))


def _first(item: str, names, default: str = "") -> Column:
    return F.coalesce(*(F.when(F.trim(F.col(f"{item}.{n}")) != "", F.trim(F.col(f"{item}.{n}"))) for n in names), F.lit(default))


def normalised_graph(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, name, layer, kind, description) and edges (graph, source, target, type, description) of JSON texts (graph, payload).

    A payload is an object with lists under any of their usual names, or one list of nodes and edges. Of nodes of one name
    the last counts; ends that no node names become components; edges from a node to itself, and texts that are no JSON, go."""
    text = F.trim("payload")
    parsed = payloads.select("graph", F.from_json(F.when(text.startswith("{"), text), _GRAPH).alias("g"), F.from_json(F.when(text.startswith("["), text), f"array<struct<{_ITEM}>>").alias("items"))
    full = lambda *names: F.coalesce(*(F.when(F.size(f"g.{n}") > 0, F.col(f"g.{n}")) for n in names))
    ends = ("source", "target", "from", "to", "outV", "inV")
    listed = parsed.select("graph", F.posexplode("items").alias("place", "x"))
    is_call = F.coalesce(*(F.when(F.col(f"x.{n}").isNotNull(), True) for n in ends), F.lit(False))
    call = lambda df: df.select("graph", _first("x", ("source", "from", "out", "outV")).alias("source"), _first("x", ("target", "to", "in", "inV")).alias("target"), _first("x", ("type", "relation_type"), DEFAULT_RELATION).alias("type"), _first("x", ("description", "desc")).alias("description"))
    node = lambda df: df.select("graph", "place", _first("x", ("name", "id", "label")).alias("name"), _first("x", ("layer", "layer_type"), DEFAULT_LAYER).alias("layer"), _first("x", ("kind", "type"), DEFAULT_KIND).alias("kind"), _first("x", ("description", "desc")).alias("description"))
    edges = call(parsed.select("graph", F.explode(full("calls", "edges", "relations")).alias("x"))).unionByName(call(listed.filter(is_call))).filter("source <> '' and target <> '' and source <> target")
    nodes = node(parsed.select("graph", F.posexplode(full("services", "nodes", "vertices")).alias("place", "x"))).unionByName(node(listed.filter(~is_call))).filter("name <> ''")
    named = edges.select("graph", F.explode(F.array("source", "target")).alias("name")).select("graph", F.lit(-1).alias("place"), "name", F.lit(DEFAULT_LAYER).alias("layer"), F.lit(DEFAULT_KIND).alias("kind"), F.lit("").alias("description"))
    last = nodes.unionByName(named).groupBy("graph", "name").agg(F.max_by(F.struct("layer", "kind", "description"), "place").alias("x"))
    return last.select("graph", "name", "x.*"), edges
