"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

from checks.compare import compare, connect
from checks.registry import QUERIES, run
from checks.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", [
    "detect_spikes", "correlate_events", "detect_numeric_anomalies", "anomaly_clusters", "transaction",
    "detect_event_pairs", "detect_thread_count_growth", "findings_digest", "latest_run_status",
])
def test_no_window_gathers_everything(spark, name):
    """No window without a partition key, no nested loop or cartesian join."""
    plan = run(spark, name, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SinglePartition" not in plan or name in ("findings_digest",)
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"\], \[\w+#\d+L? (ASC|DESC)[^\]]*\]$", window) or re.search(r"\], \[[^\]]+\], \[", window), window


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())
