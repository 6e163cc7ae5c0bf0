"""Checks by hand of documented hypotheses."""

from opslens.operators import runbook

SCHEMA = "incident string, rank int, node string, kind string, mode string, endpoint string, chain array<string>, missing array<string>, extra string"


def test_checks_of_hypotheses(spark):
    rows = [
        ("late", 1, "Redis", "Cluster", "REDIS_TIMEOUT", None, ["a", "b"], [], "x"), ("gone", 1, "redis-1", "Instance", "REDIS_UNREACHABLE", "10.0.0.1:6379", ["a"], ["no host/IP/port"], None),
        ("odd", 1, None, None, None, None, None, [None, "lacks host/IP/port"], None), ("own", 2, "svc", "Service", "APPLICATION_ERROR", "", [], None, None),
    ]
    got = {}
    for r in runbook.suggested_checks(spark.createDataFrame(rows, SCHEMA)).orderBy("incident", "rank", "place").collect():
        got.setdefault(r.incident, []).append(r)
    ids = {k: [r.check_id for r in v] for k, v in got.items()}
    assert ids["late"] == ["redis_latency", "client_pool_exhaustion", "network_path_latency", "endpoint_identity", "propagation_chain_check"]
    assert ids["gone"] == ["redis_endpoint_reachability", "redis_cluster_state"]
    assert got["gone"][0].hint == "redis-cli -h <host> -p <port> PING；nc -vz <host> <port>；日志命中 10.0.0.1:6379"
    assert ids["odd"] == ["application_error_context", "endpoint_identity"] and ids["own"] == ["application_error_context"]
    assert [r.place for r in got["late"]] == [1, 2, 3, 4, 5] and got["late"][0].target == "Redis"
    assert runbook.suggested_checks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_mode_has_checks():
    modes = [m for row in runbook.CHECKS for m in row[0]]
    assert len(set(modes)) == 15 and len({row[1] for row in runbook.CHECKS}) == len(runbook.CHECKS)
