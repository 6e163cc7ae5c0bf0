"""Checks that a conclusion proposes, bound to nodes of the catalog: targets and commands hold only addresses that a node has.

Nodes are (id, name, runtime: map of lists). Everything is an expression over a check's row and its node's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph_edits
from .lineage import cut

# Fields that make a target, in order, and those that stand in where there is neither host nor port; what a
# command template may name; addresses, hosts and ports in a command; and what is said of commands and steps that are left out.
TARGET_FIELDS = ("endpoints", "ips", "hostnames", "ports", "instance_ids", "pods", "namespaces")
OTHERS = ("instance_ids", "pods", "clusters", "namespaces", "health_checks")
PLACEHOLDER = r"\{(?:host|ip|port|endpoint|node)\}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
ENDPOINT = r"(?i)(?:https?|redis|rediss|mysql|postgres(?:ql)?|amqp|kafka)://[^\s,;]+|(?<![\w.-])(?:[a-z0-9][a-z0-9.-]*|(?:\d{1,3}\.){3}\d{1,3}):\d{2,5}(?!\d)"
NAMED_HOST = r"(?i)(?:-h\s+|--host(?:=|\s+))([a-z0-9][a-z0-9._-]*)"
NAMED_PORT = r"(?i)(?:-p|--port(?:=|\s+)|:)(\d{2,5})(?!\d)"
LACKING, NO_IP, NO_HOST, NO_PORT = "节点 {} 缺少命令模板需要的运行元数据，已隐藏参考命令", "排查命令包含未登记 IP {}，已隐藏参考命令", "排查命令包含未登记主机 {}，已隐藏参考命令", "排查命令包含未登记端口 {}，已隐藏参考命令"
UNBOUND, PORTS = "忽略未绑定到真实架构节点的排查步骤：{}", "端口 "
MOST_CHECKS, MOST_SHOWN = 8, 4
_NONE = "array<string>"


def field(runtime: Column, name: str) -> Column:
    """A field's values, without blank ones."""
    found = F.coalesce(F.try_element_at(runtime, F.lit(name)), F.array().cast(_NONE))
    return F.filter(found, lambda x: x.isNotNull() & (F.trim(x) != ""))


def target_summary(runtime: Column) -> Column:
    """What a node is reached at: endpoints, else hosts with their ports, else hosts, ports, or the first other field; four at most."""
    shown = lambda x: F.array_join(F.slice(x, 1, MOST_SHOWN), "、")
    ends, ports = field(runtime, "endpoints"), field(runtime, "ports")
    hosts = F.when(F.size(field(runtime, "ips")) > 0, field(runtime, "ips")).otherwise(field(runtime, "hostnames"))
    pairs = F.when(F.size(hosts) == F.size(ports), F.zip_with(hosts, ports, lambda h, p: F.concat_ws(":", h, p))).otherwise(F.transform(hosts, lambda h: F.concat_ws(":", h, F.get(ports, F.lit(0)))))
    has = lambda x: F.size(x) > 0
    out = F.when(has(ends), shown(ends)).when(has(hosts) & has(ports), shown(pairs)).when(has(hosts), shown(hosts)).when(has(ports), F.concat(F.lit(PORTS), shown(ports)))
    for name in OTHERS:
        out = out.when(has(field(runtime, name)), shown(field(runtime, name)))
    return out.otherwise(F.lit(""))


def host_of(endpoint: Column) -> Column:
    """The host of an address: of a URL what stands before its port and path, without a user, in lower case; else all before the last colon."""
    url = F.lower(F.regexp_extract(endpoint, r"^\w+://(?:[^/@?#]*@)?([^:/?#]*)", 1))
    return F.when(endpoint.rlike(r"^\w+://[^/?#]"), url).otherwise(F.regexp_replace(endpoint, r":[^:]*$", ""))


def trusted_command(template: Column, name: Column, runtime: Column) -> tuple[Column, Column]:
    """A command made of a template, and what is wrong with it; the command is empty where it names an address that the node lacks.

    The first fault counts: a placeholder that is left, an unknown IP, host or port; of several hosts or ports the least."""
    ips, hosts, ports, ends = (field(runtime, f) for f in ("ips", "hostnames", "ports", "endpoints"))
    first = lambda *lists: F.coalesce(*(F.get(x, F.lit(0)) for x in lists), F.lit(""))
    command = F.substring(F.trim(F.coalesce(template, F.lit(""))), 1, 600)
    for mark, value in (("{host}", first(ips, hosts)), ("{ip}", first(ips)), ("{port}", first(ports)), ("{endpoint}", F.coalesce(F.get(ends, F.lit(0)), target_summary(runtime))), ("{node}", name)):
        command = F.replace(command, F.lit(mark), value)
    every = lambda pattern, group: F.regexp_extract_all(command, F.lit(pattern), F.lit(group))
    least = lambda found, known: F.array_min(F.array_except(found, known))
    unknown_ip = F.get(F.array_except(every(IPV4, 0), ips), F.lit(0))
    known_hosts = F.concat(ips, hosts, F.transform(ends, host_of))
    named = F.concat(every(NAMED_HOST, 1), F.transform(every(ENDPOINT, 0), host_of))
    unknown_host, unknown_port = least(named, known_hosts), least(every(NAMED_PORT, 1), ports)
    say = lambda text, what: F.concat(F.lit(text.split("{}")[0]), what, F.lit(text.split("{}")[1]))
    fault = F.when(command == "", F.lit("")).when(command.rlike(PLACEHOLDER), say(LACKING, name)).when(unknown_ip.isNotNull(), say(NO_IP, unknown_ip))
    fault = fault.when(unknown_host.isNotNull(), say(NO_HOST, unknown_host)).when(unknown_port.isNotNull(), say(NO_PORT, unknown_port)).otherwise(F.lit(""))
    return F.when(fault == "", F.substring(command, 1, 500)).otherwise(F.lit("")), fault


def bound_checks(proposed: DataFrame, nodes: DataFrame) -> DataFrame:
    """decision, place, node (null where there is none), display, command, warning: the first checks of decisions, bound to nodes.

    proposed: (decision, place, node: a name or id, action, fields: array of runtime fields, template, expected). A check
    whose node isn't known is a warning; one without an action is left out."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    asked = cut(proposed.filter(F.col("place") <= MOST_CHECKS))
    known = graph_edits.catalog_ids(asked.select(F.col("node").alias("name")).filter("name is not null").distinct(), nodes)
    facts = nodes.select("id", F.col("name").alias("_name"), "runtime")
    rows = asked.join(known.select(F.col("name").alias("node"), "id"), "node", "left").join(facts, "id", "left")
    wanted = F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.array(*map(F.lit, TARGET_FIELDS)))
    target = F.map_filter(F.coalesce("runtime", F.create_map().cast("map<string,array<string>>")), lambda k, _: F.array_contains(wanted, k))
    rows = rows.withColumns({"_action": F.substring(blank("action"), 1, 500), "_target": target_summary(target)})
    command, fault = trusted_command(F.col("template"), F.col("_name"), F.coalesce("runtime", F.create_map().cast("map<string,array<string>>")))
    rows = rows.withColumns({"_command": command, "_fault": fault, "_expected": F.substring(blank("expected"), 1, 300)})
    at = F.when((F.col("_target") != "") & ~F.contains("_action", F.col("_target")), F.concat(F.lit("；目标："), "_name", F.lit("（"), "_target", F.lit("）")))
    at = at.when(~F.contains("_action", F.col("_name")), F.concat(F.lit("；节点："), "_name")).otherwise(F.lit(""))
    tail = lambda c, said: F.when(F.col(c) != "", F.concat(F.lit(said), c)).otherwise(F.lit(""))
    display = F.substring(F.concat("_action", at, tail("_command", "；参考命令："), tail("_expected", "；预期：")), 1, 1200)
    lost = F.col("id").isNull()
    before, after = UNBOUND.split("{}")
    warning = F.when(lost, F.concat(F.lit(before), F.coalesce("node", F.lit("-")), F.lit(after))).otherwise(F.col("_fault"))
    return rows.filter(lost | (F.col("_action") != "")).select(
        "decision", "place", F.col("id").alias("node"), F.when(~lost, display).otherwise("").alias("display"), F.when(~lost, F.col("_command")).otherwise("").alias("command"), warning.alias("warning")
    )


def chosen_hypotheses(decisions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """decision, rank of the hypothesis that decisions (decision, incident, candidate, place) mean: the first with that candidate
    in any case, else the one of that rank; null if there is none. hypotheses: (incident, rank, candidate)."""
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    listed = hypotheses.select("incident", F.col("rank").alias("_rank"), key("candidate").alias("_candidate"))
    named = key("candidate") != ""
    both = decisions.join(listed, "incident", "left")
    by_name, by_rank = named & (F.col("_candidate") == key("candidate")), F.col("_rank") == F.col("place")
    return both.groupBy("decision").agg(F.coalesce(F.min(F.when(by_name, F.col("_rank"))), F.min(F.when(by_rank, F.col("_rank")))).alias("rank"))


def pruned_pending(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending nodes (name, kind) and edges (source, target, type) that may be written beside known nodes (name): edges whose
    ends are pending or known and differ, and nodes that stand at one of them, or are incidents."""
    ends = nodes.select("name").unionByName(known.select("name")).distinct()
    valid = edges.filter("source <> target").join(ends.select(F.col("name").alias("source")), "source", "left_semi").join(ends.select(F.col("name").alias("target")), "target", "left_semi").select(*edges.columns)
    linked = valid.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("_linked", F.lit(True))
    kept = nodes.join(linked, "name", "left").filter(F.col("_linked") | (F.col("kind") == "Incident")).select(*nodes.columns)
    return kept, valid
