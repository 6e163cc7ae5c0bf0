"""The query of checks by hand with its DuckDB equivalent, over hypotheses made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runbook
from .registry import _query, _table

_MODES = "['REDIS_TIMEOUT', 'REDIS_UNREACHABLE', 'DATABASE_FAILURE', 'DATABASE_UNREACHABLE', 'MESSAGE_BROKER_FAILURE', 'DEPENDENCY_FAILURE', 'JVM_OOM', 'DB_DEADLOCK', 'DB_LOCK_TIMEOUT', 'DB_POOL_EXHAUSTED', 'DISK_IO_FAILURE', 'CPU_OVERLOAD', 'NETWORK_FAILURE', 'AUTH_FAILURE', 'CIRCUIT_BREAKER_OPEN', 'APPLICATION_ERROR', NULL]"
_KINDS = "['Service', 'Cluster', 'Cache', 'Database', 'Middleware', 'Queue', 'Instance', NULL]"


def _values(row) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in row)


#: Each mode's checks as SQL rows (mode, place, check, ...): the texts are the fixed values, which check belongs where is told again.
_RULES = ", ".join(f"('{m}', {i}, {_values(row[1:])})" for i, row in enumerate(runbook.CHECKS) for m in row[0])


@_query(f"""WITH h AS (SELECT o_orderkey, 'n' || o_custkey AS node, ({_KINDS})[1 + o_custkey % 8] AS kind, ({_MODES})[1 + o_orderkey % 17] AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'h' || o_custkey || ':6379' END AS endpoint, o_orderkey % 3 = 2 AS linked, o_orderkey % 4 = 1 AS lacks FROM orders),
  r(mode, step, check_id, title, priority, evidence_type, reason, hint) AS (VALUES {_RULES}), a AS (
  SELECT h.*, r.* EXCLUDE (mode) FROM h JOIN r ON r.mode = h.mode UNION ALL SELECT h.*, 0, {_values(runbook.OTHER)} FROM h WHERE mode IS NULL OR mode = 'APPLICATION_ERROR'
  UNION ALL SELECT h.*, 100, {_values(runbook.IDENTITY)} FROM h WHERE endpoint IS NULL AND (lacks OR coalesce(kind IN ('Cluster', 'Cache', 'Database', 'Middleware', 'Queue'), false)) UNION ALL SELECT h.*, 101, {_values(runbook.CHAIN)} FROM h WHERE linked)
  SELECT o_orderkey AS incident, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY step) AS INT) AS place, check_id, title, priority, node AS target, kind AS target_kind, mode, evidence_type, reason, replace(hint, '{{endpoint}}', coalesce('；日志命中 ' || endpoint, '')) AS hint FROM a""")
def runbook_checks(spark, sf_dir):
    pick = lambda values, at: F.expr(f"element_at(array({values[1:-1]}), cast(1 + {at} as int))")
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(
        key.alias("incident"), F.lit(1).alias("rank"), F.expr("'n' || o_custkey").alias("node"), pick(_KINDS, "o_custkey % 8").alias("kind"), pick(_MODES, "o_orderkey % 17").alias("mode"),
        F.when(key % 5 == 0, F.expr("'h' || o_custkey || ':6379'")).alias("endpoint"), F.when(key % 3 == 2, F.array(F.lit("a"), F.lit("b"))).when(key % 3 == 1, F.array(F.lit("a"))).alias("chain"),
        F.when(key % 4 == 1, F.array(F.lit("无 trace"), F.lit("缺少 host/IP/port 标识"))).alias("missing"),
    )
    return runbook.suggested_checks(rows).drop("rank", "chain")
