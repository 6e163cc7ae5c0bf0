"""Root causes of the documented cases: a cluster without instance evidence, and a member that the log names."""

import pytest

from opslens.operators import rca

NODES = [
    ("api-gateway", "API", {"aliases": '["gateway"]'}),
    ("security-service", "Service", {"aliases": '["security"]'}),
    ("Redis生产集群", "Cluster", {"aliases": '["redis-prod"]'}),
    *((f"redis-{i}", "Instance", {"host": f"redis-{i}", "port": "6379"}) for i in (1, 2, 3)),
]
EDGES = [("api-gateway", "security-service", "CALLS"), ("security-service", "Redis生产集群", "DEPENDS_ON"), *(("Redis生产集群", f"redis-{i}", "HAS_MEMBER") for i in (1, 2, 3))]
TIMEOUT = "io.lettuce.core.RedisCommandTimeoutException: Command timed out after 20 seconds"
REFUSED = "io.lettuce.core.RedisConnectionException: Unable to connect to redis-2:6379; connection refused | node=redis-2:6379 connection refused"
INCIDENTS = [
    ("timeout", "security-service", TIMEOUT, ["api-gateway", "security-service", "api-gateway"]),
    ("refused", "security", REFUSED, ["api-gateway"]),
    ("oom", "security-service", "java.lang.OutOfMemoryError: Java heap space", []),
    ("unknown", "nobody", "something odd", []),
]


@pytest.fixture(scope="module")
def found(spark):
    nodes = spark.createDataFrame([(n, k, "", m) for n, k, m in NODES], "name string, kind string, description string, meta map<string,string>")
    edges = spark.createDataFrame(EDGES, "source string, target string, type string")
    rows = rca.hypotheses(spark.createDataFrame(INCIDENTS, "incident string, service string, evidence string, callers array<string>"), nodes, edges).collect()
    return {(r.incident, r["rank"]): r for r in rows}


def test_timeout_stops_at_the_cluster(found):
    top = found["timeout", 1]
    # 0.30 + 0.16 own token + 0.08 kind + 0.18 one step + 0.03 cluster
    assert (top.candidate, top.mode, top.status, top.score) == ("Redis生产集群", "REDIS_TIMEOUT", "probable", 0.75)
    assert top.chain == ["Redis生产集群", "security-service", "api-gateway"]
    assert {"member_unknown", "timeout_only"} <= set(top.missing.split(","))
    # 0.30 + 0.16 + 0.08 + 0.155 two steps - 0.15 without endpoint
    assert [found["timeout", i].score for i in (2, 3, 4)] == [0.545] * 3 and found["timeout", 2].candidate == "redis-1"


def test_an_endpoint_names_the_member(found):
    top = found["refused", 1]
    assert (top.candidate, top.mode, top.status) == ("redis-2", "REDIS_UNREACHABLE", "probable") and top.score >= 0.9
    assert top.chain == ["redis-2", "Redis生产集群", "security-service", "api-gateway"]


def test_faults_inside_and_unknown_ones(found):
    assert (found["oom", 1].candidate, found["oom", 1].mode, found["oom", 1].score) == ("security-service", "JVM_OOM", 0.78)
    assert (found["unknown", 1].candidate, found["unknown", 1].kind, found["unknown", 1].mode, found["unknown", 1].score) == ("nobody", "UnresolvedDependency", "APPLICATION_ERROR", 0.3)
