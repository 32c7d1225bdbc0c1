import uuid
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventloom.config import Params
from eventloom.operators import detectors as D
from eventloom.plans import history as H
from eventloom.sources import tables
from eventloom.streaming import alerts as W

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "seq bigint, time timestamp, app string, host string, sourcetype string, error_code string, _raw string, " \
         "duration_ms double, status bigint, uri string"


def event(seq, second, app="shop", host="a", code="E1", raw="INFO ok", ms=5.0, status=200):
    return (seq, BASE + timedelta(seconds=second), app, host, "st", code, raw, ms, status, "/x")


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, **options):
    return W.stream_source(spark, path, SCHEMA, **{"maxFilesPerTrigger": "1", **options})


def drain(spark, stream, tmp_path, mode="append"):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    W.run_to_table(stream, path, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def test_row_alerts_equal_the_batch(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [event(i, i, raw="OCSP" if i % 3 == 0 else "ok", ms=900.0 * i, status=(200, 404, 503)[i % 3]) for i in range(12)]
    for part in (rows[:5], rows[5:6], rows[6:]):
        write(spark, path, part)
    got = drain(spark, W.stream_row_alerts(source(spark, path)), tmp_path)
    batch = spark.createDataFrame(rows, SCHEMA)
    want = W.tag_alerts(batch).where(~F.col("detector").isin("pattern", "spike"))
    key = ["detector", "severity", "summary", "detail_json"]
    assert sorted(got.select(key).collect()) == sorted(want.select(key).collect())
    severities = {(r["detector"], r["severity"]) for r in got.collect()}
    assert ("slow_query", "critical") in severities and ("slow_query", "warning") in severities


def test_sessions_across_files_and_out_of_order(spark, tmp_path):
    path = f"{tmp_path}/in"
    seconds = [0, 60, 121, 400, 430, 1000]
    rows = [event(i, s, app=app) for i, (s, app) in enumerate((s, a) for s in seconds for a in ("shop", "api"))]
    write(spark, path, rows[6:])
    write(spark, path, rows[:6])
    stream = W.stream_sessions(source(spark, path), "app", 60, late_seconds=3600)
    got = drain(spark, stream, tmp_path, "complete")
    want = D.correlate_events(spark.createDataFrame(rows, SCHEMA).where("app = 'shop'"), 60)
    key = ["group_start", "group_end", "event_count"]
    assert sorted(got.where("app = 'shop'").select(key).collect()) == sorted(want.select(key).collect())
    assert got.where("app = 'api'").count() == want.count() == 2  # a gap of exactly 60 s joins


def test_sessions_merge_before_the_shuffle(spark, tmp_path, capsys):
    """A key's events never meet in one task; what its tasks send there are sessions."""
    path = f"{tmp_path}/in"
    write(spark, path, [event(i, i) for i in range(50)])
    query = W.run_to_table(W.stream_sessions(source(spark, path)), f"{tmp_path}/out", "complete")
    query.awaitTermination()
    query.explain()
    plan = capsys.readouterr().out
    assert plan.rindex("MergingSessions") > plan.rindex("Exchange")
    assert spark.read.parquet(f"{tmp_path}/out").first()["event_count"] == 50


def test_grid_spikes_and_patterns(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [event(i, i, host="ab"[i % 2]) for i in range(20)] + [event(90, 90, code="E2")]
    write(spark, path, rows[:7])
    write(spark, path, rows[7:])
    spikes = drain(spark, W.stream_spikes(source(spark, path), 60, 20), tmp_path, "complete").collect()
    assert [(r["event_count"], r["hosts"]) for r in spikes] == [(20, ["a", "b"])]
    patterns = drain(spark, W.stream_patterns(source(spark, path), 60), tmp_path, "complete").collect()
    assert [(r["error_code"], r["count"]) for r in patterns] == [("E1", 20)]


def test_repeats_within_the_overlap_are_dropped(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [event(1, 0), event(2, 10)])
    write(spark, path, [event(2, 10), event(3, 20)])
    got = drain(spark, W.without_repeats(source(spark, path), ["seq"], 30), tmp_path)
    assert sorted(r["seq"] for r in got.collect()) == [1, 2, 3]


def test_lookback_applies_to_the_first_start(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [event(1, -3600), event(2, -600)])
    got = drain(spark, source(spark, path, started=BASE, lookback="-15m"), tmp_path)
    assert [r["seq"] for r in got.collect()] == [2]


PARAMS = Params(spike_window_seconds=60, spike_threshold=4)


def watch(spark, tmp_path, files):
    path, root = f"{tmp_path}/in", f"{tmp_path}/state"
    for rows in files:
        write(spark, path, rows)
        W.start_watch(source(spark, path), root, "w1", PARAMS, once=True).awaitTermination()
    return tables.read_alerts(spark, root), root


def test_watch_sees_spikes_across_cycles_and_raises_hits_once(spark, tmp_path):
    files = [
        [event(1, 0, ms=5000.0), event(2, 40), event(3, 45)],
        [event(4, 55, status=503), event(5, 58)],  # a whole window is kept: 0, 40, 45, 55, 58
        [event(6, 70, ms=1500.0)],
    ]
    alerts, root = watch(spark, tmp_path, files)
    assert sorted(p.name for p in Path(f"{root}/watch/w1").iterdir() if not p.name.startswith(".")) == ["1", "2"]
    got = [r["summary"] for r in alerts.collect()]
    # the burst began two cycles before it was complete; the third cycle finds it again, which is no new hit
    assert [s for s in got if s.startswith("Spike")] == ["Spike: 5 events in 60s starting 2026-01-01T00:00:00+00:00"]
    assert sum(s.startswith("HTTP 503") for s in got) == 1  # still in the overlap of the third cycle
    assert sum(s.startswith("Slow query: 5000ms") for s in got) == 1
    assert sum(s.startswith("Slow query: 1500ms") for s in got) == 1


def test_a_wrong_clock_does_not_end_the_overlap(spark, tmp_path):
    """Bursts that two cycles share are found in this and later cycles, although one event is of a far future."""
    future = 3600 * 24 * 365 * 70
    files = [[event(1, 0), event(2, 40), event(3, future)], [event(4, 45), event(5, 50)],
             [event(6, 300), event(7, 310)], [event(8, 320), event(9, 330)]]
    alerts, root = watch(spark, tmp_path, files)
    spikes = sorted(r["summary"] for r in alerts.collect() if r["summary"].startswith("Spike"))
    assert [s.split(" ")[1] for s in spikes] == ["4", "4"]
    assert spark.read.parquet(f"{root}/watch/w1/3/tail").where("seq = 3").isEmpty()


def test_a_cycle_spreads_a_batch_of_one_file(spark, tmp_path, monkeypatch):
    """A batch that one task reads reaches the detectors in many parts."""
    path, real, parts = f"{tmp_path}/in", W.materialize, {}
    rows = spark.range(400_000).select(
        F.col("id").alias("seq"), (F.lit(BASE) + F.make_dt_interval(secs=F.col("id") * 100)).alias("time"),
        F.lit("shop").alias("app"), F.sha2(F.col("id").cast("string"), 512).alias("_raw"))
    rows.coalesce(1).write.parquet(path)

    def seen(df, name):
        table = real(df, name)
        parts[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(W, "materialize", seen)
    stream = W.stream_source(spark, path, rows.schema, maxFilesPerTrigger="1")
    W.start_watch(stream, f"{tmp_path}/state", "w1", PARAMS, once=True).awaitTermination()
    assert parts["slice"] > 1


def test_late_events_within_the_overlap_complete_a_burst(spark, tmp_path):
    alerts, _ = watch(spark, tmp_path, [[event(1, 0), event(2, 50)], [event(3, 20), event(4, 30)]])
    assert [r["summary"].split(" ")[1] for r in alerts.collect() if r["summary"].startswith("Spike")] == ["4"]


def test_equal_hits_of_different_events_are_all_raised(spark, tmp_path):
    """Five errors of one instant, host and path; the next cycle sees them again and raises none of them."""
    alerts, _ = watch(spark, tmp_path, [[event(i, 0, status=500) for i in range(5)], [event(9, 1)]])
    assert sum(r["severity"] == "critical" for r in alerts.collect()) == 5


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([event(1, 0, ms=5000.0), event(2, 1, status=404)], SCHEMA)
    root = str(tmp_path)
    for _ in range(2):
        W.watch_cycle(batch, 0, root, "w1", PARAMS)
    rows = tables.read_alerts(spark, root).where("severity != 'info'").collect()
    assert len(rows) == len({r["alert_id"] for r in rows}) == 2


def test_two_runs_on_one_root_keep_their_alerts(spark, tmp_path):
    for run in ("a", "b"):
        W.watch_cycle(spark.createDataFrame([event(1, 0, ms=5000.0), event(2, 1, status=404)], SCHEMA), 0, str(tmp_path), run, PARAMS)
    rows = tables.read_alerts(spark, str(tmp_path)).collect()
    assert {run: sum(r["run_id"] == run for r in rows) for run in ("a", "b")} == dict.fromkeys("ab", len(rows) // 2) and rows


def test_a_failing_write_stops_the_cycle(spark, tmp_path, monkeypatch):
    real = W.materialize

    def broken(df, name):
        if name.startswith("hits-"):
            raise OSError("disk")
        return real(df, name)

    monkeypatch.setattr(W, "materialize", broken)
    with pytest.raises(OSError):
        W.watch_cycle(spark.createDataFrame([event(1, 0, ms=5000.0)], SCHEMA), 0, str(tmp_path), "w1", PARAMS)


def test_a_failing_detector_does_not_stop_the_cycle(spark, tmp_path, monkeypatch):
    def broken(found):
        raise RuntimeError("no")

    monkeypatch.setattr(W, "tag_spikes", broken)
    W.watch_cycle(spark.createDataFrame([event(1, 0, ms=5000.0)], SCHEMA), 0, str(tmp_path), "w1", PARAMS)
    assert tables.read_alerts(spark, str(tmp_path)).count() == 1


def test_quiet_cycle_and_acknowledgement(spark, tmp_path):
    alerts, root = watch(spark, tmp_path, [[event(1, 0)], [event(2, 100, status=500, code="E2", raw="INFO other")]])
    rows = alerts.collect()
    assert [r["severity"] for r in rows] == ["critical"]
    tables.alerts_ack(spark, root, [rows[0]["alert_id"]])
    assert H.alerts_open(alerts, tables.read_acks(spark, root)).isEmpty()
    assert H.alerts_open(alerts, tables.read_acks(spark, root), acked=True).count() == 1
