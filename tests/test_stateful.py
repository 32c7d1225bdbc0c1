"""Stateful streams against the batch detectors, over several micro-batches with late rows."""

import random
import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

import pytest
from pyspark.sql import functions as F

from eventloom.operators import detectors as D
from eventloom.streaming import alerts as W
from eventloom.streaming import stateful as S

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "seq bigint, time timestamp, host string, sourcetype string, error_code string, _raw string"
LATE = 30


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Events in bursts, up to 25 seconds out of order, in four files; a last event closes everything."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        at = timedelta(seconds=rng.choice([0, 50, 130, 400, 1000]) + rng.randrange(60), microseconds=rng.choice([0, 0, 500, 999_999]))
        rows.append((i, BASE + at, rng.choice(["a", "b", None]), rng.choice(["s", "t"]), rng.choice(["E1", None]),
                     rng.choice(["x 1", "y 2", "z", None, f"q{i}"])))
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(25)))
    path = str(tmp_path_factory.mktemp("log"))
    for part in (rows[:70], rows[70:75], rows[75:180], rows[180:], [(999, BASE + timedelta(days=1), "z", "z", "z", "z")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, SCHEMA)


def drained(spark, log, tmp_path, detect, *args):
    stream = detect(W.stream_source(spark, log[0], SCHEMA, maxFilesPerTrigger="1"), *args, late_seconds=LATE)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    W.run_to_table(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def same(got, want):
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert not want.isEmpty()


@pytest.mark.parametrize("window, threshold", [(60, 20), (7, 5), (150, 60)])
def test_spikes_equal_the_batch(spark, log, tmp_path, window, threshold):
    same(drained(spark, log, tmp_path, S.stream_spikes, window, threshold), D.detect_spikes(log[1], window, threshold))


@pytest.mark.parametrize("gap", [1, 60])
def test_sessions_equal_the_batch(spark, log, tmp_path, gap):
    same(drained(spark, log, tmp_path, S.stream_sessions, gap), D.correlate_events(log[1], gap))


def test_patterns_equal_the_batch_in_each_slice(spark, log, tmp_path):
    minute = F.date_trunc("minute", "time")
    slices = [D.detect_patterns(log[1].where(minute == r[0])).withColumn("slice_start", F.lit(r[0]))
              for r in log[1].select(minute).distinct().collect()]
    same(drained(spark, log, tmp_path, S.stream_patterns), reduce(lambda a, b: a.unionByName(b), slices))


def test_a_slice_keeps_its_best_beginnings_with_ties(spark, log, tmp_path):
    whole = D.detect_raw_prefixes(log[1].where(F.col("time") < F.lit(BASE + timedelta(hours=1))), top=2)
    got = drained(spark, log, tmp_path, lambda e, late_seconds: S.stream_prefixes(e, 3600, late_seconds, top=2))
    same(got, whole)
