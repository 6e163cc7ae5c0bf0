"""Incidents: regions of all flagged windows, candidates by exception class."""

import compare
import pytest

from opslens.operators import incidents
from opslens.plans import registry

SF = "/root/testdata/sf0.001"


def test_no_technical_error_is_unassigned(spark):
    left = registry.QUERIES["unassigned_errors"](spark, SF)
    assert not left.join(registry.QUERIES["technical_errors"](spark, SF), "event_id", "left_semi").count()


@pytest.mark.parametrize("name", ["candidate_scores", "root_candidates", "exception_summary"])
def test_candidates_of_the_large_tables(spark, name):
    sf = "/root/testdata/sf0.1"
    assert not compare.differ(spark, compare.tables(sf), registry.QUERIES[name], registry.ORACLE_SQL[name], sf)


def test_each_class_of_a_family_has_a_place(spark):
    classes = ["RedisCommandTimeoutException"] * 40 + ["JedisDataException", ""]
    rows = [(1, i, i, "ERROR", f"{c}: redis", c, "") for i, c in enumerate(classes)] + [(1, 99, 99, "ERROR", "redis", "", "RedisRootException")]
    members = spark.createDataFrame(rows, "region long, event_id long, event_s long, level string, message string, exception_class string, root_exception_class string")
    found = incidents.root_candidates(incidents.candidate_scores(members)).orderBy("place").collect()
    assert len(found) == 30 and {r.event_id for r in found[:4]} == {0, 40, 41, 99}
    assert {r.event_id: r.score for r in found}[99] == 5 + 4 + 3 - 99 / 60 + 3
