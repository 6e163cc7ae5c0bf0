"""How often the given tables are read: plans of queries that use a table many times."""

import pytest
from pyspark.sql import DataFrameWriter

from opslens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["root_candidates", "incident_rows", "incident_records", "run_summary", "candidate_scores", "context_join", "pattern_tops", "dynamic_edges", "hypothesis_edges", "graph_quality", "root_causes"])
def test_given_tables_are_read_a_few_times(spark, monkeypatch, name):
    """Over everything that is written on the way and the result itself: scans of the largest table, of which equal ones are read once."""
    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    found = registry.QUERIES[name](spark, SF)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    table = "lineitem.parquet" if name == "graph_quality" else "events.parquet"
    assert 1 <= sum(plan.count(f"{SF}/{table}") for plan in plans) <= 4
