"""Checks bound to nodes: targets, trusted commands, and what is hidden."""

from pyspark.sql import functions as F

from opslens.operators import checks

REDIS = {"ips": ["10.10.3.22"], "ports": ["6379"]}


def _commands(spark, rows):
    frame = spark.createDataFrame(rows, "template string, name string, runtime map<string,array<string>>")
    command, fault = checks.trusted_command(F.col("template"), F.col("name"), F.col("runtime"))
    return [tuple(r) for r in frame.coalesce(1).select(command, fault).collect()]


def test_commands_name_only_what_a_node_has(spark):
    url = {"endpoints": ["redis://user:pw@cache.local:6379/0"], "ports": ["6379"]}
    rows = [
        ("redis-cli -h {ip} -p {port} CLUSTER INFO", "n", REDIS), ("redis-cli -h 10.10.3.99 -p 6380 PING", "n", REDIS), ("redis-cli -h {host} -p6380", "n", REDIS), ("ssh -h db1 uptime", "n", REDIS),
        ("curl cache.local:6379", "n", url), ("curl other.local:6379", "n", url), ("show {node} {endpoint}", "Redis 2", REDIS), (None, "n", None), ("echo {ip}", "{port}", None), ("show {node}", "{port}", REDIS),
    ]
    assert _commands(spark, rows) == [
        ("redis-cli -h 10.10.3.22 -p 6379 CLUSTER INFO", ""), ("", "排查命令包含未登记 IP 10.10.3.99，已隐藏参考命令"), ("", "排查命令包含未登记端口 6380，已隐藏参考命令"), ("", "排查命令包含未登记主机 db1，已隐藏参考命令"),
        ("curl cache.local:6379", ""), ("", "排查命令包含未登记主机 other.local，已隐藏参考命令"), ("show Redis 2 10.10.3.22:6379", ""), ("", ""), ("echo ", ""), ("", "节点 {port} 缺少命令模板需要的运行元数据，已隐藏参考命令"),
    ]


def test_targets(spark):
    cases = [
        ({"endpoints": ["a:1", " ", "b:2"], "ips": ["x"]}, "a:1、b:2"), ({"ips": ["1", "2"], "ports": ["8", "9"]}, "1:8、2:9"), ({"hostnames": ["h", "i", "j"], "ports": ["8", "9"]}, "h:8、i:8、j:8"),
        ({"hostnames": list("abcde")}, "a、b、c、d"), ({"ports": ["8"]}, "端口 8"), ({"pods": ["p"], "clusters": ["c"]}, "p"), ({}, ""), (None, ""),
    ]
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, runtime map<string,array<string>>")
    found = {r[0]: r[1] for r in frame.select("i", checks.target_summary(F.col("runtime"))).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_the_documented_case(spark):
    nodes = spark.createDataFrame([("redis-id", "Redis实例2", REDIS)], "id string, name string, runtime map<string,array<string>>")
    proposed = [
        ("d", 1, "redis-id", "检查集群状态", ["ips", "ports"], "redis-cli -h {ip} -p {port} CLUSTER INFO", "cluster_state:ok"), ("d", 2, "redis实例2", "检查错误地址", None, "redis-cli -h 10.10.3.99 -p 6380 PING", None),
        ("d", 3, "nobody", "x", None, None, None), ("d", 4, "redis-id", " ", None, None, None), ("d", 9, "redis-id", "late", None, None, None),
    ]
    rows = checks.bound_checks(spark.createDataFrame(proposed, "decision string, place int, node string, action string, fields array<string>, template string, expected string"), nodes)
    found = {r.place: r for r in rows.collect()}
    assert set(found) == {1, 2, 3}
    assert found[1].display == "检查集群状态；目标：Redis实例2（10.10.3.22:6379）；参考命令：redis-cli -h 10.10.3.22 -p 6379 CLUSTER INFO；预期：cluster_state:ok"
    assert "10.10.3.99" not in found[2].display and "未登记 IP" in found[2].warning and (found[3].node, found[3].warning) == (None, "忽略未绑定到真实架构节点的排查步骤：nobody")
