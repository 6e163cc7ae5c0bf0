"""Ranked root causes of incidents over an architecture graph.

Incidents are rows (incident, service, evidence, callers): the service that failed first, the text of its errors, and further
services with errors in their order. Nodes are (name, kind, description, meta: map), edges (source, target, type) by name.
Of an evidence only its signals and endpoints count, so incidents are grouped by these, the service and the callers: what
follows works on these profiles, a few for each service, however many incidents there are. Signals meet nodes by joins on
equal tokens, endpoints and reachable nodes, so no profile meets a node it has nothing in common with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_rules
from . import graph, graph_edits
from .lineage import cut, small

SERVICE_KINDS, HOST_KINDS = ("Service", "API", "Component", "Pod"), ("Host", "Instance", "VM")
# Modes inside a service, and modes that start at a host.
INTERNAL = ("JVM_OOM", "AUTH_FAILURE", "CIRCUIT_BREAKER_OPEN")
AT_HOST = ("JVM_OOM", "DISK_IO_FAILURE", "CPU_OVERLOAD", "NETWORK_FAILURE", "DB_POOL_EXHAUSTED")
AT_ENDPOINT, UNKNOWN_AT = ("MESSAGE_BROKER_FAILURE", "REDIS_UNREACHABLE", "DATABASE_UNREACHABLE"), "未知组件@"
REVERSE = (*graph_edits.DEPENDENCY, "HAS_MEMBER", "CONTAINS", "HOSTED_ON", "RUNS_ON", "CONNECTS_TO")
FORWARD_DEPTH, REVERSE_DEPTH, CALLER_DEPTH = 5, 4, 4
_REDIS, _REDIS_KINDS = ("redis", "lettuce", "jedis"), ("Cache", "Cluster", "Instance", "Host", "Database", "Middleware")
_DB, _DB_KINDS = ("mysql", "database", "数据库", "jdbc"), ("Database", "Cluster", "Instance", "Host")
_MACHINES = ("Host", "Instance", "Pod", "VM")


def _rules(text: Column) -> list[tuple]:
    """Fixed values: (mode, condition, tokens of its resources, their kinds, base score, whether it is told by a timeout alone)."""
    has = lambda *words: text.rlike("|".join(words))
    late, no = has("timeout", "timed out"), F.lit(False)
    redis, refused = has(*_REDIS), has("connection refused", "redisconnectionexception", "cannot connect", "connection reset", "nic link down")
    pool, sql, dead, lock = has("hikaripool", "hikari"), has("mysql", "jdbc", "sql"), has("deadlock", "mysqltransactionrollbackexception"), has("lock wait timeout")
    plain = sql & ~dead & ~lock & ~pool
    return [
        ("JVM_OOM", has("outofmemoryerror", "java heap space", "metaspace", "gc overhead limit"), (), ("Service", "Pod", "Instance"), 0.44, no),
        ("REDIS_UNREACHABLE", redis & refused, _REDIS, _REDIS_KINDS, 0.46, no),
        ("REDIS_TIMEOUT", redis & ~refused & has("timeout", "timed out", "querytimeoutexception", "rediscommandtimeoutexception"), _REDIS, _REDIS_KINDS, 0.30, F.lit(True)),
        ("DB_POOL_EXHAUSTED", pool & has("connection is not available", "sqltransientconnectionexception", "timed out after"), ("hikari", "hikaripool", "database", "mysql", "jdbc"), ("Database", "Service", "Cluster", "Host"), 0.42, F.lit(True)),
        ("DB_DEADLOCK", sql & dead, _DB, _DB_KINDS, 0.48, no),
        ("DB_LOCK_TIMEOUT", sql & ~dead & lock, _DB, _DB_KINDS, 0.44, F.lit(True)),
        ("DATABASE_UNREACHABLE", plain & has("connection refused"), (*_DB, "hikari"), _DB_KINDS, 0.38, late),
        ("DATABASE_FAILURE", plain & ~has("connection refused"), (*_DB, "hikari"), _DB_KINDS, 0.38, late),
        ("MESSAGE_BROKER_FAILURE", has("kafka", "rabbitmq", "rocketmq", "alreadyclosedexception", "amqp"), ("kafka", "rabbitmq", "rocketmq", "mq", "amqp"), ("Queue", "Cluster", "Instance", "Host", "Middleware"), 0.40, late),
        ("DISK_IO_FAILURE", has("read-only file system", "readonly filesystem") | (has("ioexception") & has("disk", "file system", "filesystem", "/var/", "physical-host")), ("disk", "filesystem", "physical-host", "host"), _MACHINES, 0.46, no),
        ("CPU_OVERLOAD", has("cpu 100%", "cpu load", "thread contention") & has("physical-host", "host", "pod", "node"), ("cpu", "physical-host", "host", "load"), _MACHINES, 0.42, F.lit(True)),
        ("NETWORK_FAILURE", has("nic link down", "network packet loss", "hardware host crash") | (has("physical-host", "host") & has("connectexception", "unreachable", "disconnected", "packet loss")), ("physical-host", "host", "nic", "network"), ("Host", "Instance", "VM", "Cluster"), 0.48, no),
        ("AUTH_FAILURE", has(" 401 ", "unauthorized", "invalid oauth", "expired signature", "invalid token", "token expired"), (), ("Service", "API", "Component"), 0.40, no),
        ("CIRCUIT_BREAKER_OPEN", has("circuit breaker", "circuitbreaker", "hystrix", "resilience4j") & has("open", "tripped", "short-circuit", "fallback"), (), ("Service", "API", "Component", "Middleware"), 0.30, no),
    ]


def signals_of(evidence: Column) -> Column:
    """The fault modes that an evidence shows, as an array of (place, mode, tokens, kinds, base, timeout_only) in their order.

    Evidence that shows none is a failure of some dependency where it speaks of timeouts or connections, else of the application."""
    text = F.lower(text_rules.compact(evidence, 900))
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")
    signal = lambda place, mode, tokens, kinds, base, late: F.struct(F.lit(place).alias("place"), F.lit(mode).alias("mode"), words(tokens).alias("tokens"), words(kinds).alias("kinds"), F.lit(base).alias("base"), late.alias("timeout_only"))
    shown = F.array_compact(F.array(*(F.when(c, signal(i, m, t, k, b, late)) for i, (m, c, t, k, b, late) in enumerate(_rules(text)))))
    general = signal(90, "DEPENDENCY_FAILURE", (), ("Database", "Cache", "Queue", "Middleware", "Cluster", "Instance", "Host", "Service"), 0.22, text.rlike("timeout|timed out"))
    own = signal(91, "APPLICATION_ERROR", (), ("Service", "API", "Component"), 0.18, F.lit(False))
    rest = F.array(F.when(text.rlike("timeout|timed out|connection refused|connection reset"), general).otherwise(own))
    return F.when(F.size(shown) > 0, shown).otherwise(rest)


def profiled(incidents: DataFrame) -> DataFrame:
    """The incidents with their profile: service, callers, signals, endpoints and a digest of these (profile)."""
    told = incidents.select("incident", "service", "callers", signals_of(F.col("evidence")).alias("signals"), text_rules.endpoint_tokens(F.col("evidence")).alias("endpoints"))
    return told.withColumn("profile", F.md5(F.to_json(F.struct("service", "callers", "signals", "endpoints"))))


def fault_signals(profiles: DataFrame) -> DataFrame:
    """incident, place, mode, tokens, kinds, base, timeout_only: one row a fault mode."""
    return profiles.select("incident", F.explode("signals").alias("s")).select("incident", "s.*")


def searchable(nodes: DataFrame) -> DataFrame:
    """name, kind, own: the lowered text by which a node is found."""
    return nodes.select("name", "kind", F.lower(F.concat_ws(" ", "name", "kind", F.coalesce("description", F.lit("")), F.coalesce(F.to_json("meta"), F.lit("")))).alias("own"))


def endpoint_matches(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """incident, name, endpoint: nodes that an endpoint of the evidence names; a host alone counts where the evidence gives no port."""
    named = incidents.select("incident", F.explode("endpoints").alias("endpoint"))
    known = nodes.select("name", F.explode(text_rules.identifiers(F.col("name"), F.coalesce("meta", F.create_map().cast("map<string,string>")))).alias("id"))
    whole = named.join(known, named["endpoint"] == known["id"])
    hosts = named.filter(~F.contains("endpoint", F.lit(":"))).join(known.withColumn("id", F.split("id", ":")[0]), F.col("endpoint") == F.col("id"))
    return whole.unionByName(hosts).groupBy("incident", "name").agg(F.min("endpoint").alias("endpoint"))


def resolved_services(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """service, as_service, anchor of the services and callers of incidents: the service's node, and where no service is named so
    the host's."""
    names = incidents.select(F.explode(F.concat(F.array("service"), F.coalesce("callers", F.array().cast("array<string>")))).alias("service")).filter("service is not null").distinct()
    listed = nodes.select(F.col("name").alias("id"), "name", "kind", text_rules.identifiers(F.col("name"), F.coalesce("meta", F.create_map().cast("map<string,string>"))).alias("aliases"))
    named = cut(names.select(F.col("service").alias("name")))
    first = graph.resolve_entities(named, listed.filter(F.col("kind").isin(*SERVICE_KINDS))).select(F.col("name").alias("service"), F.col("id").alias("as_service"))
    first = cut(first)
    # Hosts are looked at for what is left.
    left = first.filter("as_service is null").select(F.col("service").alias("name"))
    second = graph.resolve_entities(left, listed.filter(F.col("kind").isin(*HOST_KINDS))).select(F.col("name").alias("service"), F.col("id").alias("_second"))
    if not left.limit(1).count():
        return first.withColumn("anchor", F.col("as_service"))
    return cut(first.join(second, "service", "left").select("service", "as_service", F.coalesce("as_service", "_second").alias("anchor")))


def anchors(incidents: DataFrame, resolved: DataFrame) -> DataFrame:
    """incident, anchor: the node of the service that failed first."""
    return incidents.join(resolved.select("service", "anchor"), "service").filter("anchor is not null").select("incident", "anchor")


def anchor_paths(found: DataFrame, callers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """anchor, name, path: from a service to what it depends on; for a host from what runs on it to the host. callers (caller) are
    searched from as services are, in the same steps."""
    ids = nodes.withColumn("id", F.col("name"))
    kinds = cut(found.select("anchor").distinct().join(nodes.select(F.col("name").alias("anchor"), "kind"), "anchor"))
    services, hosts = (kinds.filter(c).select(F.col("anchor").alias("id")) for c in (~F.col("kind").isin(*HOST_KINDS), F.col("kind").isin(*HOST_KINDS)))
    seeds = services.unionByName(callers.select(F.col("caller").alias("id"))).distinct()
    paths = graph_edits.shortest_paths(graph_edits.traversable(edges, ids), seeds, FORWARD_DEPTH)
    if hosts.limit(1).count():
        turned = edges.filter(F.col("type").isin(*REVERSE)).select(F.col("target").alias("source"), F.col("source").alias("target"), "type")
        paths = paths.unionByName(graph_edits.shortest_paths(turned, hosts, REVERSE_DEPTH).withColumn("path", F.reverse("path")))
    return cut(paths.select(F.col("seed").alias("anchor"), F.col("node").alias("name"), "path"))


def scored_candidates(incidents: DataFrame, nodes: DataFrame, found: DataFrame, paths: DataFrame) -> DataFrame:
    """incident, name, kind, mode, score, signals (number of signals for the node), path, endpoint, anchor, timeout_only: the
    best of each incident and node, raised for each further signal. found: (incident, anchor); paths: as anchor_paths() gives them."""
    static = nodes.filter(~F.col("kind").isin(*graph_edits.DYNAMIC))
    # What several joins read is checkpointed once.
    signals, own = cut(fault_signals(incidents)), searchable(static)
    near = cut(found.join(paths, "anchor").select("incident", "anchor", "name", "path"))
    endpoints = cut(endpoint_matches(incidents, static))
    # The texts of a path's nodes, for signals whose tokens stand on the way.
    on_path = near.select("incident", "name", F.explode("path").alias("at")).join(own.select(F.col("name").alias("at"), F.col("own").alias("_text")), "at")
    contexts = on_path.groupBy("incident", "name").agg(F.array_join(F.collect_set("_text"), " ").alias("context"))
    tokens = signals.select("tokens").distinct().select(F.explode("tokens").alias("token")).distinct()
    # There are a few dozen different tokens in all (see _rules), whatever the number of incidents.
    hits = own.join(F.broadcast(tokens), F.contains("own", "token")).select("token", "name")
    by_token = signals.select("incident", "place", F.explode("tokens").alias("token")).join(hits, "token").select("incident", "place", "name").distinct().withColumn("_own", F.lit(True))
    by_path = signals.select("incident", "place").join(near.select("incident", "name"), "incident")
    by_end = signals.select("incident", "place").join(endpoints.select("incident", "name"), "incident")
    pairs = by_token.select("incident", "place", "name").unionByName(by_path).unionByName(by_end).distinct()
    pairs = pairs.join(by_token, ["incident", "place", "name"], "left").join(signals, ["incident", "place"]).join(own.select("name", "kind"), "name")
    pairs = pairs.join(near, ["incident", "name"], "left").join(contexts, ["incident", "name"], "left").join(endpoints, ["incident", "name"], "left")
    pairs = pairs.drop("anchor").join(found, "incident", "left").join(static.select(F.col("name").alias("anchor"), F.col("kind").alias("_anchor_kind")), "anchor", "left")
    fits, has_path, direct = F.array_contains("kinds", F.col("kind")), F.col("path").isNotNull(), F.col("endpoint").isNotNull()
    on_way = F.exists("tokens", lambda t: F.contains(F.coalesce("context", F.lit("")), t))
    match = F.when(F.size("tokens") == 0, F.when(fits & has_path, 1).otherwise(0)).when(F.coalesce("_own", F.lit(False)), 2).when(fits & on_way, 1).otherwise(0)
    pairs = pairs.withColumn("match", match).filter(direct | ((F.col("match") > 0) & ~(F.col("kind").isin(*SERVICE_KINDS) & (F.col("match") < 2))))
    depth = F.size("path") - 1
    at_host = F.coalesce(F.col("_anchor_kind").isin(*HOST_KINDS), F.lit(False))
    score = (
        F.col("base") + F.when(F.col("match") >= 2, 0.16).when(F.col("match") == 1, 0.04).otherwise(0.0) + F.when(fits, 0.08).otherwise(0.0)
        + F.when(has_path, F.greatest(F.lit(0.05), 0.18 - F.greatest(depth - 1, F.lit(0)) * 0.025)).otherwise(0.0) + F.when(direct, 0.27).otherwise(0.0) + F.when(F.col("kind") == "Cluster", 0.03).otherwise(0.0)
        - F.when(F.col("kind").isin("Instance", "Host", "Pod") & ~direct & ~F.col("mode").isin(*AT_HOST) & ~at_host, 0.15).otherwise(0.0) + F.when((F.col("name") == F.col("anchor")) & has_path, 0.04).otherwise(0.0)
    )
    columns = ("incident", "name", "kind", "mode", "place", "score", "path", "endpoint", "anchor", "timeout_only")
    scored = pairs.withColumn("score", F.greatest(F.lit(0.05), F.least(score, F.lit(0.98)))).select(*columns)
    inside = signals.filter(F.col("mode").isin(*INTERNAL)).join(found, "incident").join(static.select(F.col("name").alias("anchor"), "kind"), "anchor")
    inside = inside.select("incident", F.col("anchor").alias("name"), "kind", "mode", (F.col("place") - 100).alias("place"), F.least(F.col("base") + 0.34, F.lit(0.90)).alias("score"), F.array("anchor").alias("path"), F.lit(None).cast("string").alias("endpoint"), "anchor", "timeout_only")
    every = inside.select(*columns).unionByName(scored)
    best = every.groupBy("incident", "name").agg(F.max_by(F.struct(*(c for c in columns if c not in ("incident", "name"))), F.struct("score", -F.col("place"))).alias("b"), F.count(F.lit(1)).alias("signals"))
    best = best.select("incident", "name", "signals", "b.*").withColumn("score", F.when(F.col("signals") > 1, F.least(F.col("score") + F.least((F.col("signals") - 1) * 0.03, F.lit(0.09)), F.lit(0.98))).otherwise(F.col("score")))
    best = cut(best)
    return best.unionByName(_fallback(incidents, signals, found, static, best))


def _fallback(incidents: DataFrame, signals: DataFrame, found: DataFrame, nodes: DataFrame, best: DataFrame) -> DataFrame:
    """Incidents without candidates: their anchor, else an unresolved node by the service's name, with the first signal. Where
    the evidence names an endpoint of a broker or store that the graph lacks, an unknown component there stands for the anchor."""
    first = signals.groupBy("incident").agg(F.min_by(F.struct("mode", "place", "base", "timeout_only"), "place").alias("s"))
    left = incidents.select("incident", "service", F.get("endpoints", F.lit(0)).alias("_at")).join(best.select("incident").distinct(), "incident", "left_anti").join(first, "incident").join(found, "incident", "left")
    left = left.join(nodes.select(F.col("name").alias("anchor"), "kind"), "anchor", "left")
    unnamed = F.coalesce("anchor", F.when(F.col("service") != "", F.col("service")), F.lit("未解析的故障组件"))
    unlocated = F.col("anchor").isNotNull() & F.col("_at").isNotNull() & F.col("s.mode").isin(*AT_ENDPOINT)
    return left.select(
        "incident", F.when(unlocated, F.concat(F.lit(UNKNOWN_AT), "_at")).otherwise(unnamed).alias("name"), F.lit(0).cast("long").alias("signals"),
        F.when(unlocated, "UnresolvedDependency").otherwise(F.coalesce("kind", F.lit("UnresolvedDependency"))).alias("kind"), F.col("s.mode").alias("mode"), F.col("s.place").alias("place"),
        F.when(unlocated, F.least(F.col("s.base") + 0.05, F.lit(0.38))).otherwise(F.least(F.col("s.base") + 0.12, F.lit(0.45))).alias("score"), F.when(F.col("anchor").isNotNull(), F.array("anchor")).alias("path"), F.lit(None).cast("string").alias("endpoint"), "anchor", F.col("s.timeout_only").alias("timeout_only"),
    ).select(*best.columns)


def upstream(found: DataFrame, callers: DataFrame, paths: DataFrame) -> DataFrame:
    """incident, callers: from the anchor (found) to the first of callers (incident, at, caller) that depends on it."""
    pairs = callers.join(found, "incident").filter("caller <> anchor")
    ways = paths.filter(F.size("path") <= CALLER_DEPTH + 1).select(F.col("anchor").alias("caller"), F.col("name").alias("anchor"), "path")
    return cut(pairs.join(ways, ["caller", "anchor"]).groupBy("incident").agg(F.min_by(F.reverse("path"), "at").alias("callers")))


def hypotheses(incidents: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """incident, rank, candidate, kind, mode, score, status, chain, missing: the best candidates with the way that a failure takes
    from them to the anchor and its callers, and what evidence is missing.

    Incidents are read twice: for their profiles, and to get back what was found for these, which is broadcast behind a count."""
    told = profiled(incidents)
    profiles = cut(told.groupBy("profile").agg(F.first(F.struct("service", "callers", "signals", "endpoints")).alias("x")).select(F.col("profile").alias("incident"), "x.*"))
    found = profile_hypotheses(profiles, cut(nodes), cut(edges), most)
    return told.select("incident", "profile").join(small(found.withColumnRenamed("incident", "profile")), "profile").drop("profile")


def profile_hypotheses(incidents: DataFrame, nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """hypotheses() of profiles (incident, service, callers, signals, endpoints)."""
    static = nodes.filter(~F.col("kind").isin(*graph_edits.DYNAMIC))
    resolved = resolved_services(incidents, static)
    found = cut(anchors(incidents, resolved))
    asked = incidents.select("incident", F.posexplode("callers").alias("at", "service")).join(resolved.select("service", F.col("as_service").alias("caller")), "service")
    callers = cut(asked.filter("caller is not null").select("incident", "at", "caller"))
    paths = anchor_paths(found, callers, static, edges)
    scored = cut(scored_candidates(incidents, nodes, found, paths))
    # An incident has a candidate a node at most; best ones are chosen per incident.
    place = F.row_number().over(Window.partitionBy("incident").orderBy(F.col("score").desc(), "name")).cast("long")
    top = scored.withColumn("rank", place).filter(F.col("rank") <= max(1, most))
    chain = F.coalesce(F.reverse("path"), F.array("name"))
    goes_on = F.element_at(chain, -1) == F.get("callers", F.lit(0))
    top = top.join(upstream(found, callers, paths), "incident", "left").join(graph.member_counts(edges).select(F.col("parent").alias("name"), "n_members"), "name", "left")
    ends = incidents.select("incident", (F.size("endpoints") > 0).alias("_ends"))
    gaps = F.array_compact(F.array(
        F.when(F.col("path").isNull() & ~F.coalesce(F.col("name") == F.col("anchor"), F.lit(False)), "no_path"), F.when(F.col("timeout_only"), "timeout_only"),
        F.when((F.coalesce("n_members", F.lit(0)) > 0) & ~F.col("_ends"), "member_unknown"), F.when(F.col("kind").isin("Instance", "Host", "Pod") & F.col("endpoint").isNull(), "no_endpoint"), F.when(F.col("signals") == 0, "no_dependency"),
    ))
    score = F.round("score", 3)
    status = F.when(score >= 0.75, "probable").when(score >= 0.5, "suspected").otherwise("weak")
    return top.join(ends, "incident").select(
        "incident", "rank", F.col("name").alias("candidate"), "kind", "mode", score.alias("score"), status.alias("status"),
        F.when(F.coalesce(goes_on, F.lit(False)), F.concat(chain, F.slice("callers", 2, F.size("callers")))).otherwise(chain).alias("chain"), F.array_join(gaps, ",").alias("missing"),
    )
