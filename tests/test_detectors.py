from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import PairPattern
from eventloom.operators import areas as A
from eventloom.operators import detectors as D
from eventloom.operators import saturation as S

BASE = datetime(2027, 3, 14, 5, 20, tzinfo=timezone.utc)


def nothing(spark):
    return spark.createDataFrame([], T.StructType([]))


def lines(spark, texts, **columns):
    rows = [(i, t, *[c[i] for c in columns.values()]) for i, t in enumerate(texts)]
    schema = "seq bigint, _raw string" + "".join(f", {name} string" for name in columns)
    return spark.createDataFrame(rows, schema)


def series(spark, values, host="m1", every=7):
    """One reading of ``duration_ms`` per ``every`` seconds."""
    rows = [(BASE + timedelta(seconds=every * i), host, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "time timestamp, host string, duration_ms double")


def said(spark, *entries):
    """Log lines as ``(second, host, text)``."""
    rows = [(BASE + timedelta(seconds=second), host, text, n) for n, (second, host, text) in enumerate(entries)]
    return spark.createDataFrame(rows, "time timestamp, host string, _raw string, seq bigint")


# --- slow -------------------------------------------------------------------

def test_slow_is_strict_and_slowest_first(spark):
    """Readings around a limit of 250 ms; those of exactly the limit are not slow."""
    readings = [("pump", 250.0), ("valve", 250.5), ("meter", 12.0), ("press", 7200.25), ("belt", None), ("oven", 251.0)]
    df = spark.createDataFrame(readings, "host string, latency_ms double").withColumn("spl", F.concat(F.lit("read "), "host"))
    found = [tuple(r)[:4] for r in D.detect_slow_queries(df, 250).collect()]
    assert found == [(7200.25, "latency_ms", "press", "read press"), (251.0, "latency_ms", "oven", "read oven"),
                     (250.5, "latency_ms", "valve", "read valve")]


@pytest.mark.parametrize("text, slow", [("1e3", False), ("1001", True), (" 2000", False), ("2000ms", False), ("+1.5e3", True),
                                        ("", False), (None, False), ("12d", False), ("Infinity", True)])
def test_durations_given_as_text(spark, text, slow):
    df = spark.createDataFrame([("h", text)], "hostname string, run_time string")
    assert [r["field"] for r in D.detect_slow_queries(df).collect()] == ["run_time"] * slow


def test_query_text_is_cut_at_200(spark):
    df = spark.createDataFrame([("x" * 300, 5000)], "query string, duration_ms int")
    assert len(D.detect_slow_queries(df).first()["query"]) == 200


# --- http -------------------------------------------------------------------

def test_http_classes_and_unreadable_status(spark):
    df = spark.createDataFrame([("200",), ("404",), ("404.0",), ("abc",), ("500",), ("600",), (None,), ("399",), ("400",)],
                               "status string")
    found = D.detect_http_errors(df).collect()
    assert [(r["status_code"], r["class"]) for r in found] == [(600, "5xx"), (500, "5xx"), (404, "4xx"), (400, "4xx")]


def test_http_path_is_only_taken_from_the_candidates(spark):
    df = spark.createDataFrame([("403", "/x")], "status string, uri_path string")
    assert D.detect_http_errors(df).first()["path"] is None


# --- z-score ----------------------------------------------------------------

def wave(n):
    return [40.0 + 3 * (i % 4) for i in range(n)]


def test_peak_in_a_wave_is_the_only_outlier(spark):
    (only,) = D.detect_numeric_anomalies(series(spark, [*wave(33), 910.0, *wave(6)])).collect()
    assert (only["host"], only["value"], only["window_contaminated"]) == ("m1", 910.0, False)


def test_a_wave_alone_has_no_outlier(spark):
    assert D.detect_numeric_anomalies(series(spark, wave(48))).isEmpty()


@pytest.mark.parametrize("before,flagged", [(7, 0), (8, 1)])
def test_a_row_is_judged_from_the_first_full_window_on(spark, before, flagged):
    """SURVEY N-4: the rows before, as many as the window has, are what a row is compared with."""
    found = D.detect_numeric_anomalies(series(spark, [*wave(before), 700.0]), window=8, z_threshold=2.0)
    assert found.count() == flagged


def test_outliers_close_to_an_earlier_one_are_marked(spark):
    values = [*wave(30), 640.0, 655.0, *wave(30), 900.0]
    found = D.detect_numeric_anomalies(series(spark, values), window=12, z_threshold=2.0).orderBy("time").collect()
    marks = {r["value"]: r["window_contaminated"] for r in found}
    assert marks[640.0] is False and marks.get(655.0, True) is True and marks[900.0] is False


def test_text_fields_are_not_measured(spark):
    words = spark.range(40).select(F.timestamp_seconds("id").alias("time"), F.lit("steady").alias("message"))
    assert D.detect_numeric_anomalies(words).isEmpty()


# --- pairs ------------------------------------------------------------------

def disk_pairs(frame):
    """A full disk and then a read-only mount on the same host within five minutes."""
    return D.detect_event_pairs(frame, "host", "no space left", "read-only", 300)


def test_second_event_in_time_on_the_same_host(spark):
    frame = said(spark, (2, "db7", "No space left on /var"), (9, "db8", "checkpoint done"), (251, "db7", "mount is READ-ONLY now"))
    assert [(r["entity"], r["span_seconds"]) for r in disk_pairs(frame).collect()] == [("db7", 249.0)]


@pytest.mark.parametrize("entries", [
    [(4, "db7", "remounted read-only"), (20, "db7", "no space left")],
    [(0, "db7", "no space left"), (301, "db7", "remounted read-only")],
    [(0, "db7", "no space left"), (12, "db9", "remounted read-only")],
], ids=["reversed", "late", "elsewhere"])
def test_no_pair(spark, entries):
    assert disk_pairs(said(spark, *entries)).isEmpty()


def test_pair_edges(spark):
    # the opening line is not its own second line; the second may come exactly at the span's end
    df = said(spark, (0, "a", "ocsp handshake failed"), (60, "a", "handshake failed"))
    found = D.detect_event_pairs(df, "host", "ocsp", "handshake failed", 60).collect()
    assert [r["span_seconds"] for r in found] == [60.0]
    # a null host is an entity of its own
    df = said(spark, (0, None, "ocsp"), (1, None, "handshake failed"))
    assert D.detect_event_pairs(df, "host", "ocsp", "handshake failed", 60).first()["entity"] is None


def test_several_rules_and_defaults(spark):
    df = said(spark, (0, "a", "crl fetch"), (1, "a", "OCSP"), (2, "a", "handshake failed"))
    assert {r["first_pattern"] for r in D.detect_event_pair_patterns(df).collect()} == {"ocsp", "crl"}
    rules = [PairPattern("host", "crl", "ocsp", 10), PairPattern("absent", "crl", "ocsp", 10)]
    assert [r["second_pattern"] for r in D.detect_event_pair_patterns(df, rules).collect()] == ["ocsp"]


# --- keywords ---------------------------------------------------------------

def test_cert_keywords_in_list_order_and_in_other_fields(spark):
    df = lines(spark, ["CRL then OCSP", None, "fine"], tls_error=[None, "Handshake Failed", None], host=["h", "", None])
    found = D.detect_cert_anomalies(df).orderBy("raw_excerpt").collect()
    assert [(r["host"], r["matched_keywords"], r["raw_excerpt"]) for r in found] == [
        ("unknown", ["handshake failed"], ""), ("h", ["ocsp", "crl"], "CRL then OCSP")]


def test_keywords_are_literal(spark):
    df = lines(spark, ["a.c", "abc"])
    assert [r["raw_excerpt"] for r in D.detect_cert_anomalies(df, ["a.c"]).collect()] == ["a.c"]


# --- severity and hosts -----------------------------------------------------

def test_inferred_levels_overlap_and_unknown_may_be_negative(spark):
    df = lines(spark, ["WARNING x", "warning critical error", None])
    got = {r["level"]: r["count"] for r in D.severity_summary(df).collect()}
    assert got == {"WARN": 2, "WARNING": 2, "CRITICAL": 1, "ERROR": 1, "UNKNOWN": -3}


def test_exclusive_levels_count_each_line_once(spark):
    df = lines(spark, ["WARNING x", "warn y", "warning critical error", "info debug", "none", None])
    got = {r["level"]: r["count"] for r in D.severity_summary(df, exclusive=True).collect()}
    assert got == {"WARNING": 1, "WARN": 1, "CRITICAL": 1, "INFO": 1, "UNKNOWN": 2}


def test_explicit_level_keeps_nulls(spark):
    df = spark.createDataFrame([("warn",), ("WARN",), (None,)], "log_level string")
    assert {r["level"]: r["count"] for r in D.severity_summary(df).collect()} == {"WARN": 2, None: 1}


def test_host_ranking_keeps_null_host_and_breaks_ties(spark):
    df = lines(spark, ["error", "Critical", "ERROR", "ok", "error"], src=["b", "a", None, "a", None])
    assert [(r["host"], r["error_count"]) for r in D.host_error_ranking(df).collect()] == [(None, 2), ("a", 1), ("b", 1)]


# --- patterns ---------------------------------------------------------------

def test_patterns(spark):
    df = lines(spark, ["x" * 80 + "1", "x" * 80 + "2", "y"], sourcetype=["s", "s", None], EventCode=["1", "1", "2"])
    got = [(r["type"], r["sourcetype"], r["error_code"], r["prefix"], r["count"]) for r in D.detect_patterns(df).collect()]
    assert got == [("repeated_error", "s", "1", None, 2), ("repeated_raw_prefix", None, None, "x" * 60, 2)]


def test_prefix_top_ten_is_deterministic(spark):
    df = lines(spark, [f"line {i:02d}" for i in range(15)] * 2)
    assert [r["prefix"] for r in D.detect_raw_prefixes(df).collect()] == [f"line {i:02d}" for i in range(10)]


# --- saturation -------------------------------------------------------------

def test_backlog_counts_per_state(spark):
    df = lines(spark, ["CLOSE_WAIT and TIME_WAIT"] * 5 + ["close_wait"], host=["a"] * 6)
    assert [(r["state"], r["count"]) for r in S.detect_socket_backlog(df, 5).collect()] == [("close_wait", 6), ("time_wait", 5)]


def test_growth_compares_with_the_previous_nonempty_bucket(spark):
    rows = [(BASE, "10"), (BASE + timedelta(seconds=900), "20"), (BASE + timedelta(seconds=1200), "0"),
            (BASE + timedelta(seconds=1500), "50"), (BASE + timedelta(seconds=1800), "oops")]
    df = spark.createDataFrame(rows, "time timestamp, thread_count string")
    found = S.detect_thread_count_growth(df).collect()
    # 10 -> 20 doubles; after a zero bucket there is no ratio; unreadable values drop out
    assert [(r["prev_avg"], r["current_avg"], r["growth_ratio"]) for r in found] == [(10.0, 20.0, 2.0)]


def test_latency_needs_all_three_values(spark):
    rows = [(BASE, 4, 10.0), (BASE, 6, 30.0), (BASE, None, 99.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "time timestamp, active_threads int, latency_ms double")
    got = S.correlate_latency_load(df).collect()
    assert [(r["avg_threads"], r["avg_latency_ms"], r["event_count"]) for r in got] == [(5.0, 20.0, 2)]


def test_latency_follows_load(spark):
    rows = [(BASE + timedelta(seconds=300 * i), n, 2.5 * n) for i, n in enumerate((4, 9, 2, 7))]
    df = spark.createDataFrame(rows, "time timestamp, active_threads int, latency_ms double")
    (only,) = S.latency_load_correlation(df).collect()
    assert only["windows"] == 4 and only["correlation"] == pytest.approx(1.0)


def test_filled_timeline_has_every_minute(spark):
    rows = [(BASE + timedelta(seconds=s), h) for s, h in ((5, "a"), (50, "b"), (190, "a"))]
    df = spark.createDataFrame(rows, "time timestamp, host string")
    ask = A.FollowUp(hosts=["a", "b"])
    assert [(r["a"], r["b"]) for r in A.timeline_chart(df, ask, filled=True).collect()] == [(1, 1), (0, 0), (0, 0), (1, 0)]
    assert A.timeline_chart(df.limit(0), ask, filled=True).isEmpty()


def test_verdict_ladder(spark):
    def verdict(texts):
        row = S.saturation_verdict(lines(spark, texts)).first()
        return row["confidence"], row["signals"], row["event_count"]

    assert verdict(["fine"]) == ("Low", 0, 1)
    assert verdict(["Queue full"]) == ("Medium", 1, 1)
    assert verdict(["Queue full", "Full GC"]) == ("High", 2, 2)


# --- absent columns ---------------------------------------------------------

def test_every_detector_accepts_a_frame_without_columns(spark):
    for detector in (
        D.detect_spikes, D.detect_repeated_errors, D.detect_raw_prefixes, D.detect_patterns, D.correlate_events,
        D.detect_event_pair_patterns, D.detect_cert_anomalies, D.severity_summary, D.host_error_ranking,
        D.detect_slow_queries, D.detect_http_errors, D.detect_numeric_anomalies, D.anomaly_clusters,
        S.detect_thread_exhaustion, S.detect_socket_backlog, S.detect_gc_pressure, S.detect_thread_count_growth,
        S.correlate_latency_load, S.saturation_host_ranking,
    ):
        assert detector(nothing(spark)).isEmpty(), detector.__name__
    assert S.saturation_verdict(nothing(spark)).first()["event_count"] == 0


def test_host_is_optional_for_spikes_and_sessions(spark):
    df = spark.createDataFrame([(BASE,), (BASE,)], "time timestamp")
    assert D.detect_spikes(df, 60, 2).first()["hosts"] == ["unknown"]
    assert D.correlate_events(df).first()["sourcetypes"] == ["unknown"]


def test_a_timestamp_without_zone_counts_as_utc(spark):
    df = spark.createDataFrame([(BASE,), (BASE,)], "time timestamp").select(F.col("time").cast("timestamp_ntz").alias("time"))
    assert D.detect_spikes(df, 60, 2).first()["event_count"] == 2
