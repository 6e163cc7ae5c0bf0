"""Nodes and relations of an architecture text, worked out by hand."""

from opslens.operators import entities

DEMO = """# 认证平台架构说明

认证平台由网关层、业务服务层和基础设施层组成。

- API网关服务，日志服务名（serviceName）为 `api-gateway`，负责接收外部请求。
- 安全服务，日志服务名（serviceName）为 `security-service`，负责读取安全配置。
- API网关服务调用安全服务。
- 安全服务依赖 Redis生产集群，并从 Redis生产集群查询安全配置。
- Redis生产集群包含 redis-1、redis-2、redis-3 三个实例。
- redis-1 的 host=redis-1，ip=10.0.2.11，port=6379。
- redis-2 的 host=redis-2，ip=10.0.2.12，port=6379。
"""


def found(spark, rows, schema="doc int, text string"):
    nodes, edges = entities.extracted(spark.createDataFrame(rows, schema))
    return {(r.doc, r.name): r for r in nodes.collect()}, {tuple(r) for r in edges.select("doc", "source", "target", "type").collect()}


def test_demo(spark):
    nodes, edges = found(spark, [(1, DEMO)])
    assert nodes[1, "安全服务"].aliases == ["security-service"] and nodes[1, "API网关服务"].aliases == ["api-gateway"]
    n = nodes[1, "redis-2"]
    assert (n.kind, n.layer, n.host, n.ip, n.port) == ("Instance", "基础设施层", "redis-2", "10.0.2.12", 6379)
    assert {(1, "API网关服务", "安全服务", "CALLS"), (1, "安全服务", "Redis生产集群", "READS"), (1, "Redis生产集群", "redis-2", "HAS_MEMBER")} <= edges
    assert nodes[1, "Redis生产集群"].kind == "Cluster"


def test_sentences(spark):
    text = "商城系统由网关层、数据层组成；订单服务写入订单数据库。订单服务发布消息到Kafka\n库存服务订阅订单事件。用户服务提供登录、注册功能，读取Redis缓存。支付服务对接银联平台。"
    nodes, edges = found(spark, [(1, text), (2, None), (3, " "), (4, "plain words only")])
    want = {
        ("商城系统", "网关层", "CONTAINS"), ("商城系统", "数据层", "CONTAINS"), ("订单服务", "订单数据库", "WRITES"), ("订单服务", "Kafka", "PUBLISHES"), ("库存服务", "Kafka", "SUBSCRIBES"),
        ("用户服务", "登录功能", "PROVIDES"), ("用户服务", "注册功能", "PROVIDES"), ("用户服务", "Redis缓存", "READS"), ("支付服务", "银联平台", "CALLS"),
    }
    assert {e[1:] for e in edges} == want
    kinds = {name: (r.kind, r.layer) for (_, name), r in nodes.items()}
    assert kinds["订单数据库"] == ("Database", "数据层") and kinds["Kafka"] == ("Queue", "中间件层") and kinds["登录功能"] == ("Function", "功能层")
    assert kinds["商城系统"] == ("System", "系统层") and kinds["网关层"] == ("Layer", "网关层") and kinds["银联平台"] == ("Component", "Component层")
    assert {doc for doc, _ in nodes} == {1}


def test_nothing(spark):
    assert found(spark, []) == ({}, set())
    nodes, _ = found(spark, [(1, "订单服务调用库存服务", "x"), (1, "订单服务调用库存服务", None)], "doc int, text string, name string")
    assert set(nodes) == {(1, "订单服务"), (1, "库存服务")}
