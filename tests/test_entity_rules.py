"""Which rule's find of a name counts, and what keeps the work on a text small."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from opslens.operators import entities
from opslens.plans import registry


def test_first_rule_counts_wherever_its_find_stands(spark):
    """The rule of caches, which knows the layer, goes before that of dependencies, though the name is its second find and the other's first."""
    nodes, _ = entities.extracted(spark.createDataFrame([(1, "订单服务依赖 Memcached缓存。安全服务依赖 Redis甲集群。支付服务访问 Redis乙集群。")], "doc int, text string"))
    found = {r.name: (r.kind, r.layer) for r in nodes.collect()}
    assert found["Redis甲集群"] == found["Redis乙集群"] == ("Cluster", "数据层")


def test_edges_alone_are_one_pass(spark, monkeypatch):
    """No table on the way, no array of edges computed once for a filter and again for its rows, and more tasks than the one small file."""
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **kwargs: (written.append(args), write(self, *args, **kwargs))[1])
    found = registry.QUERIES["architecture_edges"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not written and not any("Filter" in line and "transform(" in line for line in plan.splitlines())
    assert "Repartition 12" in plan or "RepartitionByExpression" in plan


def test_relations_equal_the_edges_of_nodes_and_edges(spark):
    texts = spark.createDataFrame([(1, "商城系统由网关层、数据层组成；订单服务写入订单数据库。订单服务发布消息到Kafka\n库存服务订阅订单事件"), (2, "Redis集群包含redis-1和redis-2。用户服务提供登录、注册功能，读取Redis缓存"), (None, "甲服务调用乙服务"), (3, None), (4, " ")], "doc int, text string")
    edges = {tuple(r) for r in entities.relations(texts).collect()}
    assert edges == {tuple(r) for r in entities.extracted(texts)[1].collect()} and len(edges) == 11


def test_names_are_cut_as_by_all_cuts(spark):
    names = ["", " ", "订单服务", " 订单服务 ", "- * 订单服务", "和、订单服务的", "包含和订单服务", "订单由网关组成", "redis 3个实例", "成", "例", "：x；", "x  ", "x\x85", "x\n", "a-b", "-", "#", "由由x", "x" * 100]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    plain = F.col("n")
    for pattern in entities.NAME_CUTS:
        plain = F.regexp_replace(plain, pattern, "")
    assert df.filter(~entities.clean_name(F.col("n")).eqNullSafe(F.substring(plain, 1, entities.MOST_NAME))).collect() == []


def test_few_and_many_addressed_names(spark, monkeypatch):
    text = "。".join(f"redis-{i} 的 host=h{i}，port={6000 + i}" for i in range(12))
    texts = spark.createDataFrame([(1, text), (2, "redis-1 的 host=other。redis-2，ip=10.0.0.2")], "doc int, text string")
    rows = lambda: {tuple(r[:2]) + tuple(r[5:]) for r in entities.extracted(texts)[0].collect()}
    few = rows()
    monkeypatch.setattr(entities, "FEW_NAMES", 3)
    assert rows() == few and {(1, "redis-1", "h1", None, 6001), (1, "redis-11", "h11", None, 6011), (2, "redis-1", "other", None, None), (2, "redis-2", None, "10.0.0.2", None)} <= few
