import bz2
import gzip
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom import session
from eventloom.operators import detectors as D
from eventloom.operators.normalize import prepare_events
from eventloom.plans import findings as P
from eventloom.plans import history as H
from eventloom.sources import catalog, json_pieces, readers, tables

CERT_EVENTS = [
    {"_time": "2026-03-01T10:00:00Z", "host": "gw-1", "sourcetype": "ocsp", "_raw": "OCSP check failed", "error_code": "T1",
     "tls_error": "timeout", "ocsp_status": "timeout"},
    {"_time": "2026-03-01T10:00:30Z", "host": "web-2", "sourcetype": "ssl", "_raw": "validation failed: certificate expired",
     "error_code": "X9"},
    {"_time": "2026-03-01T10:01:00Z", "host": "gw-1", "sourcetype": "ocsp", "_raw": "OCSP check failed", "error_code": "T1"},
    {"_time": "2026-03-01T10:03:00Z", "host": "lb-3", "sourcetype": "ocsp", "_raw": "An error: Revocation list stale",
     "error_code": "R2", "Source": "a", "source": "b"},
]


def save(tmp_path, name, data):
    path = tmp_path / name
    path.write_text(data if isinstance(data, str) else json.dumps(data, indent=1))
    return str(path)


@pytest.mark.parametrize("shape", ["envelope", "list", "lines"])
def test_json_shapes(spark, tmp_path, shape):
    if shape == "lines":
        path = save(tmp_path, "e.json", "\n".join(json.dumps(e) for e in CERT_EVENTS))
    else:
        path = save(tmp_path, "e.json", {"results": CERT_EVENTS} if shape == "envelope" else CERT_EVENTS)
    events = readers.read_events_json(spark, path, lines=shape == "lines")
    assert events.count() == 4 and {"Source", "source"} <= set(events.columns)


@pytest.mark.parametrize("data", [{"rows": []}, {"results": []}, [], {"results": 5}])
def test_json_without_events(spark, tmp_path, data):
    events = readers.read_events_json(spark, save(tmp_path, "e.json", data))
    assert events.isEmpty()
    assert P.findings_counts(P.analyze_events(events)[0]).where("n > 0").isEmpty()


@pytest.mark.parametrize("shape", ["envelope", "one-line envelope", "list", "lines", "csv"])
def test_the_form_is_told_by_how_the_file_begins(spark, tmp_path, shape):
    rows = [{"n": str(i), "_raw": "x" * 300} for i in range(400)]
    text = {"envelope": json.dumps({"results": rows}, indent=1), "one-line envelope": json.dumps({"results": rows}),
            "list": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows)),
            "csv": "n,_raw\n" + "\n".join(f"{r['n']},{r['_raw']}" for r in rows)}[shape]
    before = spark.conf.get("spark.sql.caseSensitive")
    assert readers.read_events(spark, save(tmp_path, "export", text)).count() == 400
    assert spark.conf.get("spark.sql.caseSensitive") == before


@pytest.mark.parametrize("envelope", [True, False])
def test_documents_are_cut_into_events(spark, tmp_path, monkeypatch, envelope):
    """No row holds a document: its events are rows of text, also those that lie in several blocks of the file and runs of pieces."""
    rows = [{"n": i, "_raw": 'a "b" \\ {[\u00e9]}, \\' * (i % 4), "in": {"x": [{"results": [{"y": i}]}, {}], "z": [[1], []]}} for i in range(90)]
    data = {"messages": [{"results": [{"n": -1}]}], "results": rows, "more": [{"q": 1}]} if envelope else rows
    path = save(tmp_path, "e.json", json.dumps(data, ensure_ascii=False))
    monkeypatch.setattr(json_pieces, "RUN_BITS", 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = json_pieces.event_lines(spark, path, envelope)
        events = readers.read_events_json(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((json.loads(r["value"]) for r in spark.read.text(lines).collect()), key=lambda e: e["n"]) == rows
    assert path not in {f.removeprefix("file://") for f in events.inputFiles()}
    got = events.select("n", "_raw", F.to_json("in.z").alias("z")).orderBy("n").collect()
    assert [(r["n"], r["_raw"], json.loads(r["z"])) for r in got] == [(e["n"], e["_raw"], e["in"]["z"]) for e in rows]


@pytest.mark.parametrize("text", ['[{"a": 1}, null]', '[{"a": 1}, {"a": }]', '[{"a": 1}', '[{"a": 1}] [{"a": 2}]', '{"results": [{"a": 1}, 2]}'])
def test_other_documents_are_not_cut(spark, tmp_path, text):
    assert json_pieces.event_lines(spark, save(tmp_path, "e.json", text), text.startswith("{")) is None


def packed(tmp_path, name, text, pack):
    path = tmp_path / f"{name}.json.{'gz' if pack is gzip else 'bz2'}"
    path.write_bytes(pack.compress(text.encode()))
    return str(path)


@pytest.mark.parametrize("pack", [gzip, bz2])
@pytest.mark.parametrize("shape", ["envelope", "list", "lines"])
def test_packed_files(spark, tmp_path, shape, pack):
    rows = [{"n": str(i), "_raw": "x" * 300} for i in range(400)]
    text = {"envelope": json.dumps({"results": rows}), "list": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows))}[shape]
    path = packed(tmp_path, "e", text, pack)
    assert readers.read_events(spark, path).where("n is not null").count() == 400
    assert readers.read_events_json(spark, path, lines=shape == "lines").where("n is not null").count() == 400


LONG = 'a "b" \\ {[é' * 20_000
LONG_FORMS = {
    "lines, nested": ({"_raw": LONG, "inner": {"results": [{"a": 1}]}}, {"_raw": "y", "inner": None}),
    "lines, nested first": ({"inner": {"results": [{"a": 1}]}, "_raw": LONG}, {"_raw": "y", "inner": None}),
    "lines, text": ({"_raw": LONG + '"results": [{'}, {"_raw": "y"}),
    "lines, scalar": ({"results": 5, "_raw": LONG}, {"results": 6, "_raw": "y"}),
    "lines, numbers": ({"results": [5], "_raw": LONG}, {"results": [], "_raw": "y"}),
    "short lines, scalar": ({"results": 5, "_raw": "x"}, {"results": 6, "_raw": "y"}),
    "late results": ({"note": LONG, "more": {"results": 1}, "results": [{"_raw": "x"}, {"_raw": "y"}]},),
}


@pytest.mark.parametrize("form", sorted(LONG_FORMS))
def test_long_first_lines(spark, tmp_path, form):
    path = save(tmp_path, "e", "\n".join(map(json.dumps, LONG_FORMS[form])) + "\n")
    assert readers.read_events(spark, path).where("_raw is not null").count() == 2


def test_drifted_lines_lose_nothing(spark, tmp_path):
    path = save(tmp_path, "e.json", '{"n": 1, "tags": ["a"]}\n{"n": "12x", "fresh": {"k": 2}}\n\nbroken\n{"n": null}\n')
    got = readers.read_events_lines(spark, path, "n bigint, tags array<string>").collect()
    assert [(r["n"], r["tags"]) for r in got] == [(1, ["a"]), (None, None), (None, None), (None, None)]
    assert [r["extra"] for r in got] == [None, {"n": "12x", "fresh": '{"k":2}'}, {"_line": "broken"}, None]


NESTED = "d struct<a:bigint,list:array<struct<x:bigint>>,m:map<string,bigint>>, s string"


@pytest.mark.parametrize("body, typed, kept", [
    ('{"d": {"a": 1, "list": [{"x": 2}, null], "m": {"k": 3}}, "s": "t"}', (1, [2, None], {"k": 3}), False),
    ('{"d": {"a": "12x", "new": 1}}', (None, None, None), True),
    ('{"d": {"a": 1, "list": [{"x": 2, "y": 5}]}}', (1, [2], None), True),
    ('{"d": {"a": 1, "list": [{"x": "p"}, {"x": 4}]}}', (1, [None, 4], None), True),
    ('{"d": {"a": 1, "m": {"k": "v", "j": 6}}}', (1, None, {"k": None, "j": 6}), True),
    ('{"d": {"a": 1, "list": {"x": 2}}}', (1, None, None), True),
    ('{"d": {"a": 1, "a": 2}}', None, True), ('{"d": [1]}', None, True), ('{"d": null}', None, False),
])
def test_nested_drift_is_kept(spark, tmp_path, body, typed, kept):
    row = readers.read_events_lines(spark, save(tmp_path, "e.json", body + "\n"), NESTED).first()
    if typed is not None:
        d = row["d"]
        assert (d["a"], d["list"] and [x and x["x"] for x in d["list"]], d["m"]) == typed
    assert (row["extra"] is not None) == kept
    if kept:
        given = json.loads(body, object_pairs_hook=list)
        assert json.loads(row["extra"]["d"], object_pairs_hook=list) == dict(given)["d"]


def test_a_field_named_twice_keeps_the_line(spark, tmp_path):
    body = '{"s": "a", "s": "b"}'
    assert readers.read_events_lines(spark, save(tmp_path, "e.json", body), NESTED).first()["extra"] == {"_line": body}


@pytest.mark.parametrize("text, n", [
    ('{"results": 3, "time": "x"}', 1), ('{"results": [1, 2]}', 1), ('{"results": [{"a": 1}], "n": 1}\n{"results": [{"a": 2}]}\n', 2),
    ('\ufeff{"results": []}\n\n{"n": 1}\n{"n": 2}', 3), ('{"results": [\n{"a": 1},\n{"a": 2}\n]}', 2), ('{"results": [{"a": 1}, {"a": 2}]}\n', 2),
])
def test_events_with_a_field_named_results(spark, tmp_path, text, n):
    assert readers.read_events(spark, save(tmp_path, "e", text)).count() == n


def rows_scanned(df):
    """Rows that the file scan of a collected frame gave out."""
    def scans(plan):
        if "FileSourceScan" in plan.getClass().getName():
            yield plan.metrics().apply("numOutputRows").value()
        for i in range(plan.children().size()):
            yield from scans(plan.children().apply(i))

    df.collect()
    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_a_rare_host_skips_row_groups(spark, tmp_path):
    """Host names are spread over all of the time; the row groups without the wanted one are not read."""
    path, day = str(tmp_path / "table"), datetime(2026, 1, 1)
    events = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1767225600) + F.col("id") % 86400).alias("time"), F.lit("s").alias("sourcetype"),
        F.when(F.col("id") == 77_777, "host-8 rare").otherwise(F.concat(F.lit("host-"), F.sha2(F.col("id").cast("string"), 256))).alias("host"),
        F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        readers.write_event_table(events, path, files=8)
        found = readers.scan_events(spark, path, day + timedelta(days=1), hosts=["host-8 rare"])
        assert rows_scanned(found) <= 30_000 and [r["seq"] for r in found.collect()] == [77_777]
        assert rows_scanned(readers.scan_events(spark, path, day + timedelta(days=1))) == 200_000
        readers.write_event_table(events, f"{path}-plain", files=8, indexed=())
        assert rows_scanned(readers.scan_events(spark, f"{path}-plain", day + timedelta(days=1), hosts=["host-8 rare"])) == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_records_keep_line_breaks_in_quotes(spark, tmp_path):
    path = save(tmp_path, "r.csv", 'time,note\n2026-01-01 00:00:00,"two\nlines"\n2026-01-02 00:00:00,one\n')
    got = readers.read_records(spark, path).orderBy("time").collect()
    assert [r["note"] for r in got] == ["two\nlines", "one"] and got[1]["time"] is not None


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    cluster = type("Session", (), {"conf": Conf({"spark.master": "spark://host:7077"})})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)
    cluster.conf.set("spark.checkpoint.dir", "hdfs:///scratch/")
    assert session.scratch_root(cluster) == "hdfs:///scratch"


def test_a_scope_leaves_no_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    with session.scratch_scope(spark):
        assert session.materialize(spark.range(3), "numbers").count() == 3
    assert list(tmp_path.iterdir()) == []


def test_alerts_of_both_writers_are_read(spark, tmp_path):
    hits = spark.createDataFrame([("d", "warning", "s", "{}")], "detector string, severity string, summary string, detail_json string")
    tables.write_alerts(hits, str(tmp_path), "a/b")
    tables.store_alerts(tables.alert_rows(hits, "w"), str(tmp_path), "w", "0")
    tables.store_alerts(tables.alert_rows(hits, "w"), str(tmp_path), "w", "0")
    assert sorted(r["run_id"] for r in tables.read_alerts(spark, str(tmp_path)).collect()) == ["a/b", "w"]


def test_scalar_and_list_in_one_field_widen_to_text(spark, tmp_path):
    path = save(tmp_path, "e.json", [{"value": "x"}, {"value": ["p", "q"]}])
    scalar, listed = [r["value"] for r in readers.read_events_json(spark, path).collect()]
    assert scalar == "x" and json.loads(listed) == ["p", "q"]


def test_csv_is_all_text(spark, tmp_path):
    path = save(tmp_path, "e.csv", 'host,n,_raw\na,1,"two\nlines, ""quoted"""\n')
    events = readers.read_events_csv(spark, path)
    assert set(dict(events.dtypes).values()) == {"string"}
    assert events.first()["_raw"] == 'two\nlines, "quoted"'


def test_content_decides_not_the_name(spark, tmp_path):
    assert readers.read_events(spark, save(tmp_path, "a.txt", {"results": CERT_EVENTS})).count() == 4
    assert readers.read_events(spark, save(tmp_path, "b.json", "host,n\na,1\n")).columns == ["host", "n"]


def test_records_by_extension(spark, tmp_path):
    path = save(tmp_path, "r.json", [{"time": "2026-03-01T10:00:00Z", "n": 1}, {"time": "bad", "n": 2}])
    got = {r["n"]: r["time"] for r in readers.read_records(spark, path).select(F.col("time").cast("timestamp_ntz"), "n").collect()}
    assert got == {1: datetime(2026, 3, 1, 10), 2: None}
    assert readers.read_records(spark, save(tmp_path, "r.csv", "time,n\n2026-03-01 10:00:00,1\n")).dtypes == [
        ("time", "timestamp"), ("n", "int")]
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.parquet")


def test_whole_analysis_of_an_export(spark, tmp_path):
    events = readers.read_events(spark, save(tmp_path, "e.json", {"results": CERT_EVENTS}))
    found, report = P.analyze_events(events)
    counts = {r["type"]: r["n"] for r in P.findings_counts(found).collect()}
    assert counts == {"spikes": 0, "patterns": 2, "cert_anomalies": 4, "correlations": 1, "host_ranking": 1,
                      "slow_queries": 0, "numeric_anomalies": 0, "event_pairs": 0}
    summary = P.run_summary(found).first()
    assert (summary["n_findings"], summary["error"], summary["top_error_host"]) == (6, 1, "lb-3")
    lines = [r["line"] for r in report.collect()]
    assert lines[0] == "# Findings" and "## Cert Anomalies (4)" in lines and "- lb-3: 1 errors" in lines
    path = str(tmp_path / "report")
    tables.write_report_lines(report, path)
    assert spark.read.text(path).count() == len(lines)


@pytest.mark.parametrize("drop", [(), ("time", "_time"), ("host",), ("sourcetype", "error_code"), ("_raw",)])
def test_one_pass_gives_the_same_findings(spark, drop):
    rows = [(i, str(1000 + i // 2), "ab"[i % 2], "st", f"E{i % 3}", (i % 7) * 500.0 if i != 25 else 90000.0,
             ("OCSP error", "TLS handshake failed", "WARNING crl", None)[i % 4], "timeout" if i % 5 == 0 else None)
            for i in range(40)]
    events = prepare_events(spark.createDataFrame(
        rows, "seq bigint, _time string, host string, sourcetype string, error_code string, duration_ms double, "
              "_raw string, tls_error string")).drop(*drop)
    apart = P.build_findings(events, share=False)
    apart["event_pairs"] = D.detect_event_pair_patterns(events)
    if "_raw" in drop:
        once = P.build_findings(events, share=True) | {"event_pairs": apart["event_pairs"]}
    else:
        once = P.shared_findings(events)
    assert set(once) == set(apart)
    for kind, found in apart.items():
        assert once[kind].columns == found.columns, kind
        assert sorted(map(str, once[kind].collect())) == sorted(map(str, found.collect())), kind


def test_scan_prunes_and_is_half_open(spark, tmp_path):
    base = datetime(2026, 3, 1, tzinfo=timezone.utc)
    rows = [(base + timedelta(hours=h), "s" if h % 2 else "t", f"h{h % 3}") for h in range(96)]
    path = str(tmp_path / "events")
    readers.write_event_table(spark.createDataFrame(rows, "time timestamp, sourcetype string, host string"), path)
    now = base + timedelta(hours=72)
    assert readers.scan_events(spark, path, now).count() == 24
    narrow = readers.scan_events(spark, path, now, "-30h", "-1h", ["s"], ["h1", "h2"])
    assert narrow.count() == len([r for r in rows if now - timedelta(hours=30) <= r[0] < now - timedelta(hours=1)
                                  and r[1] == "s" and r[2] != "h0"])
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(time" in plan


# --- history tables ---------------------------------------------------------

def test_events_round_trip(spark, tmp_path):
    root = str(tmp_path)
    events = prepare_events(spark.createDataFrame(CERT_EVENTS[:3]))
    tables.write_events(events, root, "r1")
    tables.write_events(events.limit(1), root, "r2")
    got = tables.load_run_events(spark, root, "r1", "error_code string, relative_offset_s double").collect()
    assert [(r["_time"][11:19], r["error_code"], r["relative_offset_s"], r["app"]) for r in got] == [
        ("10:00:00", "T1", 0.0, ""), ("10:00:30", "X9", 30.0, ""), ("10:01:00", "T1", 60.0, "")]
    assert tables.load_run_events(spark, root, "r1").first()["extra"]["error_code"] == "T1"


def test_findings_table(spark, tmp_path):
    found = P.build_findings(prepare_events(spark.createDataFrame(CERT_EVENTS[:3])))
    tables.write_findings(found, str(tmp_path), "r1")
    stored = spark.read.parquet(f"{tmp_path}/findings").where("type = 'cert_anomalies'").collect()
    assert {(r["run_id"], r["severity"]) for r in stored} == {("r1", "cert_anomaly")}
    assert json.loads(stored[0]["body_json"])["matched_keywords"]


def test_queries_reports_and_runs(spark, tmp_path):
    root = str(tmp_path)
    tables.write_queries(spark, root, "r1", 1, ["-- api_errors\nindex=a\n| stats count", "index=b"])
    tables.write_queries(spark, root, "r1", 2, ["-- timeline\nindex=c"], [7])
    queries = tables.read_table(spark, root, "investigation_queries", tables.QUERY_SCHEMA)
    got = H.run_queries(queries, "r1").collect()
    assert [(r["iteration"], r["area"], r["spl"], r["executed"], r["result_rows"]) for r in got] == [
        (1, "api_errors", "index=a\n| stats count", False, None), (1, "", "index=b", False, None),
        (2, "timeline", "index=c", True, 7)]
    assert [r["spl"] for r in H.query_examples_recent(queries, limit=1).collect()] == ["index=c"]

    tables.write_report(spark, root, "r1", "**confidence:** low", "f.json")
    tables.write_report(spark, root, "r1", "x **Confidence:** High")
    reports = tables.read_table(spark, root, "reports", tables.REPORT_SCHEMA)
    assert [(r["source"], r["confidence"]) for r in H.run_history(reports).collect()] == [("—", "High"), ("f.json", "low")]
    assert {r["report_md"] for r in H.run_detail(reports, queries).collect()} == {"x **Confidence:** High"}

    assert tables.read_runs(spark, root).isEmpty()
    tables.log_run_update(spark, root, "r1", source="live", iteration=1, unknown=5)
    tables.log_run_update(spark, root, "r1", iteration=2)
    tables.log_run_update(spark, root, "r2", source="file")
    one = H.latest_run_status(tables.read_runs(spark, root), "r1").first()
    assert (one["source"], one["iteration"]) == ("live", 2)
    assert H.latest_run_status(tables.read_runs(spark, root)).first()["run_id"] == "r2"
    tables.clear_run(spark, root, "r1")
    assert H.latest_run_status(tables.read_runs(spark, root), "r1").isEmpty()
    tables.log_run_update(spark, root, "r1", iteration=1)
    assert H.latest_run_status(tables.read_runs(spark, root), "r1").first()["source"] is None


def test_area_stats_median_of_even_and_odd(spark):
    rows = [("a", True, v) for v in (1, 2, 4, 10)] + [("b", True, 5), ("b", False, 9), ("b", True, None), (None, True, 3)]
    df = spark.createDataFrame(rows, "area string, executed boolean, result_rows bigint")
    got = {r["area"]: (r["executed_count"], r["avg_result_rows"], r["median_result_rows"]) for r in H.query_area_stats(df).collect()}
    assert got == {"a": (4, 4.25, 3.0), "b": (1, 5.0, 5.0), "": (1, 3.0, 3.0)}


@pytest.mark.parametrize("report,iteration,queries,new,want", [
    ("**Confidence:** High", 1, 2, 5, "done"), ("**Confidence:** Medium", 3, 2, 5, "done"),
    ("**Confidence:** Medium", 1, 0, 5, "done"), ("**Confidence:** Medium", 1, 2, 0, "done"), ("none", 2, 1, 1, "continue"),
])
def test_investigation_status(spark, report, iteration, queries, new, want):
    df = spark.createDataFrame([(report, iteration, queries, new)], "report string, iteration int, n_queries int, n_new int")
    assert H.investigation_status(df).first()["status"] == want


def test_grow_investigation_stops_without_new_rows(spark):
    events = prepare_events(spark.createDataFrame(CERT_EVENTS[:2]))
    assert P.grow_investigation(events, None)[0] == "done"
    assert P.grow_investigation(events, spark.createDataFrame(CERT_EVENTS[:1]).limit(0))[0] == "done"
    status, grown, found = P.grow_investigation(events, spark.createDataFrame(CERT_EVENTS[2:3]))
    assert status == "continue" and grown.count() == 3 and found["event_count"].first()[0] == 3


def test_report_keeps_every_row_of_complete_sections(spark):
    events = prepare_events(spark.createDataFrame([(str(i), f"ocsp {i}", "h") for i in range(40)],
                                                  "_time string, _raw string, host string"))
    report = P.findings_report(P.build_findings(events))
    assert report.where(F.col("line").startswith("- [h] ocsp")).count() == 40


# --- catalogue --------------------------------------------------------------

def moment(day):
    return datetime(2026, 3, day)


def test_catalog_merge_reset_and_load(spark, tmp_path):
    rows = [("s", "a", 1, moment(1)), ("s", None, 2, moment(2)), ("t", None, 3, moment(3))]
    seen = catalog.observe_columns(spark.createDataFrame(rows, "sourcetype string, value string, n bigint, time timestamp"))
    merged = catalog.schema_catalog_upsert(None, seen)
    fresh = spark.createDataFrame([("s", "value", "array<string>", moment(5), moment(6))], catalog.CATALOG_SCHEMA)
    updated = {(r["sourcetype"], r["field_name"]): (r["dtype"], r["first_seen"].day, r["last_seen"].day)
               for r in catalog.schema_catalog_upsert(merged, fresh).collect()}
    assert updated[("s", "value")] == ("array<string>", 1, 6) and updated[("s", "n")] == ("bigint", 1, 2)
    assert ("t", "value") not in updated  # never filled for that sourcetype
    reset = {(r["sourcetype"], r["field_name"]): r["dtype"] for r in catalog.schema_catalog_reset(merged, fresh, ["s"]).collect()}
    assert reset == {("s", "value"): "array<string>", ("t", "sourcetype"): "string", ("t", "n"): "bigint"}
    path = str(tmp_path / "catalog")
    catalog.write_catalog(merged, path)
    catalog.write_catalog(catalog.schema_catalog_upsert(None, fresh), path)  # replaces s only
    stored = catalog.read_catalog(spark, path)
    assert catalog.schema_catalog_load(stored, "s") == T.StructType([T.StructField("value", T.ArrayType(T.StringType()))])
    assert catalog.schema_catalog_load(stored, "t")["n"].dataType == T.LongType()
    assert catalog.schema_catalog_load(stored, "unseen") is None


def test_drift_of_json_values(spark):
    rows = [("s", '{"v": "x", "n": 1}', moment(1)), ("s", '{"v": ["x"], "n": 2}', moment(2)), ("t", '{"v": null}', moment(3))]
    seen = catalog.observe_json(spark.createDataFrame(rows, "st string, body string, at timestamp"), "body", "st", "at")
    assert [(r["sourcetype"], r["field_name"], r["dtypes"]) for r in catalog.schema_drift(seen).collect()] == [
        ("s", "v", ["array<string>", "string"])]


def test_nested_types_are_stored_whole(spark):
    rows = spark.createDataFrame([("s", (1, ["x"]), moment(1))], "sourcetype string, d struct<a:bigint,list:array<string>>, time timestamp")
    stored = catalog.schema_catalog_upsert(None, catalog.observe_columns(rows))
    assert catalog.schema_catalog_load(stored, "s")["d"].dataType == rows.schema["d"].dataType
    odd = spark.createDataFrame([("s", "f", "struct<a b:int>", moment(1), moment(1))], catalog.CATALOG_SCHEMA)
    assert catalog.schema_catalog_load(odd, "s")["f"].dataType == T.StringType()


def test_detectors_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame(CERT_EVENTS[:3]).write.parquet(path)
    plan = D.host_error_ranking(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_raw:string,host:string>" in plan
