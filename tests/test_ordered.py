import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.operators import detectors as D
from eventloom.operators import ordered
from eventloom.operators import transaction as transactions_module
from eventloom.operators.transaction import transaction
from tests import models
from tests.frames import BASE, US, as_frame, random_events


def micros(name):
    return F.unix_micros(name)


@pytest.mark.parametrize("how", ["sum", "last"])
@pytest.mark.parametrize("bits,level", [(2, 4), (3, 3), (17, 2)])
def test_prefix_equals_running_value(spark, how, bits, level):
    rng = random.Random(bits)
    keys = rng.sample(range(250), 80)
    rows = [(k, None if rng.random() < 0.3 else rng.randrange(9)) for k in keys]
    df = spark.createDataFrame(rows, "key bigint, value bigint")
    got = {r["key"]: r["before"] for r in ordered.prefix(df, "key", "value", "before", how, level, bits).collect()}
    total, last = 0, None
    for key, value in sorted(rows):
        assert got[key] == (total if how == "sum" else last)
        total += value or 0
        last = value if value is not None else last


@pytest.mark.parametrize("how", ["sum", "last"])
@pytest.mark.parametrize("keys", [
    [-9, -5, 5, 9], [5, 9, 2**34 + 5, 2**34 + 9], [-(2**51) - 1, -(2**51), -1, 0, 2**51, 2**51 + 1], [-(2**62), 0, 2**62 - 1],
], ids=["signs", "2^34", "2^51", "ends"])
def test_prefix_goes_on_across_blocks(spark, how, keys):
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key bigint, value bigint")
    got = {r["key"]: r["before"] for r in ordered.prefix(df, "key", "value", "before", how).collect()}
    for i, k in enumerate(sorted(keys)):
        assert got[k] == (sum(range(1, i + 1)) if how == "sum" else i or None)


def test_sessions_apart_by_decades_stay_apart(spark):
    """Before and after 1970, where the cells of the axis change sign, and far beyond 2**34 microseconds."""
    moments = [datetime(1969, 3, 1, 12, 0, s) for s in (0, 30)] + [datetime(2024, 3, 1, 12, 0, s) for s in (0, 30)]
    df = spark.createDataFrame([(t, f"h{i}", "log") for i, t in enumerate(moments)], "time timestamp, host string, sourcetype string")
    got = [(r["event_count"], r["span_seconds"]) for r in D.correlate_events(df, 60).collect()]
    assert got == [(2, 30.0), (2, 30.0)]


def test_one_dense_session_holds_each_source_once(spark):
    df = spark.range(5000).select(
        F.timestamp_micros(F.col("id") * US).alias("time"), F.concat(F.lit("h"), F.col("id") % 7).alias("host"),
        F.lit("log").alias("sourcetype"))
    (only,) = D.correlate_events(df, 2).collect()
    assert only["event_count"] == 5000 and len(only["hosts"]) == 7


def test_number_rows_is_the_global_position(spark):
    events = random_events(5, 300, 50, null_times=False)
    df = as_frame(spark, events).select(micros("time").alias("us"), "seq")
    numbered, total = ordered.number_rows(df, "us", "seq")
    want = [(e["us"], e["seq"]) for e in models.in_order(events)]
    got = [(r["us"], r["seq"]) for r in numbered.orderBy("idx").collect()]
    assert total == 300 and got == want
    assert [r["idx"] for r in numbered.orderBy("idx").collect()] == list(range(300))


@pytest.mark.parametrize("seed,window,threshold,step", [
    (1, 60, 6, US), (2, 7, 5, 1000), (3, 1, 3, 250_000), (4, 200, 20, US), (5, 0, 2, US),
])
def test_spikes_equal_the_model(spark, seed, window, threshold, step):
    events = random_events(seed, 160, 900, step)
    found = D.detect_spikes(as_frame(spark, events), window, threshold)
    got = [(r["us"], r["event_count"], tuple(r["hosts"]))
           for r in found.withColumn("us", micros("window_start")).collect()]
    want = models.spikes(events, window, threshold)
    assert want and got == want


def test_spike_window_is_closed_and_first_of_the_minute_wins(spark):
    at = [0, 10, 60, 70]  # 0..60 holds three events; so does 10..70
    events = [{"seq": i, "us": BASE + s * US, "host": "a", "raw": "", "value": 1.0} for i, s in enumerate(at)]
    found = D.detect_spikes(as_frame(spark, events), 60, 3).withColumn("us", micros("window_start")).collect()
    assert [(r["us"], r["event_count"]) for r in found] == [(BASE, 3)]


@pytest.mark.parametrize("seed,gap,step", [(1, 5, US), (2, 2, 1000), (3, 60, US), (4, 0, US), (5, 1, 500_000)])
def test_sessions_equal_the_model(spark, seed, gap, step):
    events = random_events(seed, 150, 600, step)
    found = D.correlate_events(as_frame(spark, events), gap)
    got = [(r["a"], r["b"], r["event_count"], tuple(r["hosts"]))
           for r in found.withColumns({"a": micros("group_start"), "b": micros("group_end")}).collect()]
    want = models.sessions(events, gap)
    assert want and got == want


@pytest.mark.parametrize("seed,span", [(1, 30), (2, 300), (3, 0), (4, 90)])
def test_pairs_equal_the_model(spark, seed, span):
    events = random_events(seed, 120, 600)
    found = D.detect_event_pairs(as_frame(spark, events), "host", "OCSP", "handshake failed", span)
    got = sorted(
        ((r["entity"], r["a"], r["b"])
         for r in found.withColumns({"a": micros("first_time"), "b": micros("second_time")}).collect()), key=str)
    assert got == models.pairs(events, "ocsp", "handshake failed", span)


@pytest.mark.parametrize("seed,span,leaf_rows", [(1, 20, 1), (2, 20, 3), (3, 120, 2), (4, 0, 4), (5, 50, 8), (6, 7, 1 << 16)])
def test_transactions_equal_the_model(spark, seed, span, leaf_rows):
    """Small leaves: cells of too many instants, leaves of several cells, and several rounds of composed jumps."""
    events = random_events(seed, 250, 700, 100_000)
    found = transaction(as_frame(spark, events), "host", span, leaf_rows)
    got = sorted(
        ((r["host"], r["a"], r["b"], r["event_count"])
         for r in found.withColumns({"a": micros("start_time"), "b": micros("end_time")}).collect()), key=str)
    assert got == models.transactions(events, span)


@pytest.mark.parametrize("step_us,leaf_rows", [(US, 50), (997, 200)])
def test_no_task_holds_a_hot_key(spark, monkeypatch, step_us, leaf_rows):
    """One key, an event a second or thousands within one span: groups that are gathered stay near ``leaf_rows``."""
    rng = random.Random(9)
    events = [{"seq": i, "us": BASE + i * step_us + rng.randrange(step_us), "host": "a", "raw": "", "value": 1.0} for i in range(1500)]
    sizes, walk = [], transactions_module._walk

    def measured(placed, entries, span):
        sizes.extend(r["count"] for r in placed.where("not dense").groupBy("key", "leaf").count().collect())
        return walk(placed, entries, span)

    monkeypatch.setattr(transactions_module, "_walk", measured)
    found = transaction(as_frame(spark, events), "host", 1 if step_us < US else 30, leaf_rows)
    got = sorted((r["host"], r["a"], r["b"], r["event_count"])
                 for r in found.withColumns({"a": micros("start_time"), "b": micros("end_time")}).collect())
    assert got == models.transactions(events, 1 if step_us < US else 30)
    assert max(sizes, default=0) <= 2 * leaf_rows


def test_transaction_of_a_regular_stream_keeps_its_phase(spark):
    """Chains entering at different events of a strictly periodic stream never merge."""
    events = [{"seq": i, "us": BASE + i * 3 * US, "host": "a", "raw": "", "value": 1.0} for i in range(400)]
    found = transaction(as_frame(spark, events), "host", 10, 2)
    got = sorted((r["host"], r["a"], r["b"], r["event_count"])
                 for r in found.withColumns({"a": micros("start_time"), "b": micros("end_time")}).collect())
    assert got == models.transactions(events, 10)


@pytest.mark.parametrize("seed,window,threshold,block", [(1, 20, 3.0, 64), (2, 5, 1.5, 16), (3, 12, 2.5, 65536)])
def test_anomalies_equal_the_model(spark, monkeypatch, seed, window, threshold, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    monkeypatch.setattr(ordered.with_halo, "__defaults__", (block,))
    events = random_events(seed, 400, 300)
    df = as_frame(spark, events).withColumn("host", F.col("seq").cast("string"))
    got = {
        (r["us"], int(r["host"])): (round(r["z_score"], 6), r["window_contaminated"])
        for r in D.detect_numeric_anomalies(df, window=window, z_threshold=threshold)
        .withColumn("us", micros("time")).collect()
    }
    want = models.anomalies(events, window, threshold)
    assert want and got == want


def test_halo_longer_than_a_block(spark):
    numbered = spark.range(50).withColumnRenamed("id", "idx")
    rows = ordered.with_halo(numbered, 9, block_rows=4).collect()  # blocks grow to the halo
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r["idx"])
    assert sorted(blocks[1]) == list(range(0, 18))
