"""Queries of architecture texts and metadata with their DuckDB equivalents, over texts made of customers, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import architecture
from ..operators import entities
from .registry import _query, _table

_NAMES = """c_name || CASE c_custkey % 14 WHEN 0 THEN '系统' WHEN 1 THEN '层' WHEN 2 THEN '服务' WHEN 3 THEN ' userDB' WHEN 4 THEN ' Redis 集群' WHEN 5 THEN ' redis' WHEN 6 THEN ' cluster' WHEN 7 THEN '节点' WHEN 8 THEN ' Kafka' WHEN 9 THEN ' nacos'
  WHEN 10 THEN ' 网关' WHEN 11 THEN '功能' WHEN 12 THEN ' x' ELSE ' memcached' END"""


@_query(f"""WITH n AS (SELECT c_custkey, c_custkey % 14 AS k, CASE WHEN c_custkey % 28 = 12 THEN 'redis-node-' || c_custkey ELSE {_NAMES} END AS name FROM customer),
  i AS (SELECT c_custkey, name, CASE WHEN c_custkey % 28 = 12 THEN 'Instance' ELSE ['System', 'Layer', 'Service', 'Database', 'Cluster', 'Cache', 'Cluster', 'Instance', 'Queue', 'Middleware', 'API', 'Function', 'Component', 'Cache'][k + 1] END AS kind FROM n)
  SELECT c_custkey, name, kind, CASE kind WHEN 'System' THEN '系统层' WHEN 'Layer' THEN '系统层' WHEN 'Service' THEN '业务服务层' WHEN 'Database' THEN '数据层' WHEN 'Cache' THEN '数据层' WHEN 'Cluster' THEN '基础设施层' WHEN 'Instance' THEN '基础设施层'
    WHEN 'Queue' THEN '中间件层' WHEN 'Middleware' THEN '中间件层' WHEN 'API' THEN '网关层' WHEN 'Function' THEN '功能层' ELSE 'Component层' END AS layer FROM i""")
def inferred_kinds(spark, sf_dir):
    name = F.expr(f"case when c_custkey % 28 = 12 then 'redis-node-' || c_custkey else {_NAMES} end")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), architecture.inferred_kind(name).alias("kind"))
    return rows.withColumn("layer", architecture.default_layer(F.col("kind")))


@_query(r"""WITH m AS (SELECT p_partkey, p_partkey % 70000 AS port, p_partkey % 300 AS octet, p_name FROM part) SELECT p_partkey, CASE WHEN port BETWEEN 1 AND 65535 THEN CAST(port AS VARCHAR) || CASE WHEN port <> 80 THEN '|80' ELSE '' END ELSE '80' END AS ports,
  CASE WHEN octet <= 255 THEN '10.0.0.' || octet ELSE '' END AS ips, 'Host-' || p_partkey AS hostnames, 'http://h:1/x' AS endpoints, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a' || p_partkey END AS aliases FROM m""")
def runtime_metadata(spark, sf_dir):
    port, octet = F.col("p_partkey") % 70000, F.col("p_partkey") % 300
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    alias = F.when(F.col("p_partkey") % 3 == 0, text("password=", F.col("p_partkey"))).otherwise(text("a", F.col("p_partkey")))
    meta = F.create_map(
        F.lit("port"), text('["', port, '", "80", "x"]'), F.lit("ip_address"), text("10.0.0.", octet), F.lit("host"), text("Host-", F.col("p_partkey"), ", host-", F.col("p_partkey")),
        F.lit("address"), F.lit("http://u:p@h:1/x?q=1"), F.lit("alias"), alias, F.lit("comment"), F.lit("kept out"),
    )
    rows = _table(spark, sf_dir, "part").select("p_partkey", architecture.runtime_meta(meta).alias("m"))
    return rows.select("p_partkey", *(F.coalesce(F.array_join(F.col("m")[c], "|"), F.lit("")).alias(c) for c in ("ports", "ips", "hostnames", "endpoints", "aliases")))


_PAYLOAD = """CASE n_nationkey % 3 WHEN 0 THEN '{"nodes": [{"id": "' || n_name || '", "type": "Service"}, {"name": " "}], "edges": [{"from": "' || n_name || '", "to": "db"}, {"from": "x", "to": "x"}]}'
  WHEN 1 THEN '[{"label": "' || n_name || '", "layer": "L", "desc": "d"}, {"label": "' || n_name || '", "kind": "Cluster"}, {"outV": "' || n_name || '", "inV": "q", "type": "USES"}]' ELSE 'not json' END"""


@_query("""SELECT n_nationkey AS graph, n_name AS name, 'Component层' AS layer, CASE n_nationkey % 3 WHEN 0 THEN 'Service' ELSE 'Cluster' END AS kind FROM nation WHERE n_nationkey % 3 < 2
  UNION ALL SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'db' ELSE 'q' END, 'Component层', 'Component' FROM nation WHERE n_nationkey % 3 < 2""")
def normalised_nodes(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("graph"), F.expr(_PAYLOAD).alias("payload"))
    return architecture.normalised_graph(rows)[0].drop("description")


@_query("SELECT n_nationkey AS graph, n_name AS source, CASE n_nationkey % 3 WHEN 0 THEN 'db' ELSE 'q' END AS target, CASE n_nationkey % 3 WHEN 0 THEN 'CALLS' ELSE 'USES' END AS type FROM nation WHERE n_nationkey % 3 < 2")
def normalised_edges(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("graph"), F.expr(_PAYLOAD).alias("payload"))
    return architecture.normalised_graph(rows)[1].drop("description")


_TEXT = """CASE c_custkey % 3 WHEN 0 THEN replace('订单#服务，日志服务名（serviceName）为 `order-#`，负责接收请求。' || chr(10) || '订单#服务调用库存#服务。库存#服务写入库存#数据库。', '#', CAST(c_custkey AS VARCHAR))
  WHEN 1 THEN replace('安全#服务依赖 Redis#集群，并从 Redis#集群查询配置；Redis#集群包含 redis-1#、redis-2# 2个实例。redis-1# 的 host=h#，ip=10.0.0.' || CAST(c_custkey % 250 AS VARCHAR) || '，port=6379。', '#', CAST(c_custkey AS VARCHAR))
  ELSE replace('商城#系统由网关层、数据层组成。支付#服务对接银联#平台。支付#服务发布消息到Kafka。', '#', CAST(c_custkey AS VARCHAR)) END"""


def _texts(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.expr(_TEXT.replace("VARCHAR", "STRING")).alias("text"))


@_query("""WITH v(k, name, kind, layer) AS (VALUES (0, '订单#服务', 'Service', '业务服务层'), (0, '库存#服务', 'Service', '业务服务层'), (0, '库存#数据库', 'Database', '数据层'), (0, '接收请求功能', 'Function', '功能层'),
    (1, '安全#服务', 'Service', '业务服务层'), (1, 'Redis#集群', 'Cluster', '数据层'), (1, 'redis-1#', 'Instance', '基础设施层'), (1, 'redis-2#', 'Instance', '基础设施层'),
    (2, '商城#系统', 'System', '系统层'), (2, '网关层', 'Layer', '网关层'), (2, '数据层', 'Layer', '数据层'), (2, '网关', 'API', '网关层'), (2, '支付#服务', 'Service', '业务服务层'), (2, '银联#平台', 'Component', 'Component层'), (2, 'Kafka', 'Queue', '中间件层'))
  SELECT c_custkey AS doc, replace(name, '#', c_custkey::VARCHAR) AS name, kind, layer, CASE WHEN name = '订单#服务' THEN 'order-' || c_custkey ELSE '' END AS aliases, CASE WHEN name = 'redis-1#' THEN 'h' || c_custkey END AS host,
    CASE WHEN name = 'redis-1#' THEN '10.0.0.' || c_custkey % 250 END AS ip, CASE WHEN name = 'redis-1#' THEN 6379 END AS port FROM customer JOIN v ON k = c_custkey % 3""")
def architecture_nodes(spark, sf_dir):
    return entities.extracted(_texts(spark, sf_dir))[0].withColumn("aliases", F.array_join("aliases", ","))


@_query("""WITH v(k, source, target, type) AS (VALUES (0, '订单#服务', '接收请求功能', 'PROVIDES'), (0, '订单#服务', '库存#服务', 'CALLS'), (0, '库存#服务', '库存#数据库', 'WRITES'), (1, '安全#服务', 'Redis#集群', 'READS'), (1, 'Redis#集群', 'redis-1#', 'HAS_MEMBER'), (1, 'Redis#集群', 'redis-2#', 'HAS_MEMBER'),
    (2, '商城#系统', '网关层', 'CONTAINS'), (2, '商城#系统', '数据层', 'CONTAINS'), (2, '支付#服务', '银联#平台', 'CALLS'), (2, '支付#服务', 'Kafka', 'PUBLISHES'))
  SELECT c_custkey AS doc, replace(source, '#', c_custkey::VARCHAR) AS source, replace(target, '#', c_custkey::VARCHAR) AS target, type FROM customer JOIN v ON k = c_custkey % 3""")
def architecture_edges(spark, sf_dir):
    return entities.relations(_texts(spark, sf_dir)).select("doc", "source", "target", "type")
