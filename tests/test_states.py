"""Investigations from mergeable states against one run over all events."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.config import Params
from eventloom.operators.normalize import append_events, prepare_events
from eventloom.plans import findings as P
from eventloom.plans.states import investigate
from tests.frames import BASE, US

PARAMS = Params(spike_window_seconds=20, spike_threshold=4, correlate_window_seconds=3, slow_threshold_ms=50,
                anomaly_window=5, anomaly_z_threshold=1.5)
LINES = ("OCSP lookup failed", "ERROR TLS handshake failed", "INFO ok", "WARNING queue", "CRITICAL disk", None)


def steps(seed, n=3, rows=60):
    """Event frames that overlap in time, with distinct ``seq`` over all of them."""
    rng = random.Random(seed)
    for step in range(n):
        yield [{
            "seq": step * 1000 + i,
            "_time": None if rng.random() < 0.05 else str((BASE + rng.randrange(200) * US // rng.choice([1, 2])) / US),
            "_raw": rng.choice(LINES), "host": rng.choice(["a", "b", "", None]), "sourcetype": rng.choice(["s", "t", None]),
            "error_code": rng.choice(["E1", "E2", None]), "duration_ms": float(rng.choice([1, 2, 3, 60, 900])),
        } for i in range(rows)]


SCHEMA = ("seq bigint, _time string, _raw string, host string, sourcetype string, error_code string, duration_ms double")


def rows_of(found):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found.collect())


def same_as_one_run(spark, frames):
    state, union = investigate(prepare_events(frames[0]), PARAMS), prepare_events(frames[0])
    for more in frames[1:]:
        status, state, found = state.grow(more)
        assert status == "continue"
        union = append_events(union, prepare_events(more))
    whole = P.build_findings(union, PARAMS)
    assert set(found) == set(whole)
    for kind, rows in whole.items():
        assert found[kind].columns == rows.columns, kind
        assert rows_of(found[kind]) == rows_of(rows), kind
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_equals_one_run(spark, seed):
    found = same_as_one_run(spark, [spark.createDataFrame(rows, SCHEMA) for rows in steps(seed)])
    assert all(rows.count() for rows in found.values())


def test_fields_may_change_between_steps(spark):
    """Later steps bring fields that take precedence, lack others, and differ in type."""
    a, b, c = (spark.createDataFrame(rows, SCHEMA) for rows in steps(3))
    first = a.withColumnRenamed("host", "src").withColumnRenamed("error_code", "event_code").drop("duration_ms")
    second = b.withColumn("duration_ms", F.col("duration_ms").cast("int")).withColumn("level", F.lit("warn"))
    third = c.drop("_raw", "sourcetype").withColumn("error_code", F.length("error_code"))
    same_as_one_run(spark, [first, second, third])
    same_as_one_run(spark, [third.drop("host"), first])


def test_a_step_reads_states_and_new_events_only(spark, tmp_path):
    old, new = (str(tmp_path / name) for name in ("old", "new"))
    for path, rows in zip((old, new), steps(4, 2)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    state = investigate(prepare_events(spark.read.parquet(old)), PARAMS)
    before = state.findings()
    _, grown, found = state.grow(spark.read.parquet(new))
    for kind, rows in {**found, **before}.items():
        plan = rows._jdf.queryExecution().toString()
        assert old not in plan and new not in plan, kind
    assert [r["event_count"] for r in (before["event_count"].first(), found["event_count"].first())] == [60, 120]
    assert grown.grow(None)[0] == "done" and grown.grow(spark.read.parquet(new).limit(0))[2] is None
