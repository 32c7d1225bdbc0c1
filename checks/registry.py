"""One registered query per operator, run over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.content import content, content_of_json
from eventloom.config import PairPattern, Params
from eventloom.functions import relative_time as relative
from eventloom.operators import areas as A
from eventloom.operators import detectors as D
from eventloom.operators import normalize as N
from eventloom.operators import saturation as S
from eventloom.operators.transaction import transaction as transaction_operator
from eventloom.plans import findings as P
from eventloom.plans import history as H
from eventloom.plans.states import investigate
from eventloom.session import scratch_root
from eventloom.sources import catalog, readers, tables
from eventloom.sources.sample import log_columns, sample_log, table
from eventloom.streaming import alerts as W
from eventloom.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.caseSensitive", "true")
    return plain(QUERIES[name](spark, sf_dir))


def plain(df: DataFrame) -> DataFrame:
    """Comparable form: lists as joined text, timestamps without a zone, doubles at six digits."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            col = F.array_join(col, ",")
        elif isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            col = F.round(col, 6)
        out.append(col.alias(f.name))
    return df.select(*out)


# --- core detectors ---------------------------------------------------------

SAMPLE_PAIRS = [
    PairPattern("host", "ocsp", "handshake failed", 86400),
    PairPattern("sourcetype", "pool exhausted", "close_wait", 7200),
]


@query
def detect_spikes(spark, sf):
    return D.detect_spikes(sample_log(spark, sf), 3600, 25)


@query
def detect_spikes_short(spark, sf):
    return D.detect_spikes(sample_log(spark, sf), 600, 7)


@query
def detect_repeated_errors(spark, sf):
    return D.detect_repeated_errors(sample_log(spark, sf))


@query
def detect_raw_prefixes(spark, sf):
    return D.detect_raw_prefixes(table(spark, sf, "documents").withColumnRenamed("text", "_raw"))


@query
def detect_patterns(spark, sf):
    return D.detect_patterns(sample_log(spark, sf))


@query
def correlate_events(spark, sf):
    return D.correlate_events(sample_log(spark, sf), 60)


@query
def detect_event_pairs(spark, sf):
    return D.detect_event_pairs(sample_log(spark, sf), "host", "ocsp", "handshake failed", 86400)


@query
def detect_event_pair_patterns(spark, sf):
    return D.detect_event_pair_patterns(sample_log(spark, sf), SAMPLE_PAIRS)


@query
def detect_cert_anomalies(spark, sf):
    return D.detect_cert_anomalies(sample_log(spark, sf))


@query
def severity_summary(spark, sf):
    return D.severity_summary(sample_log(spark, sf))


@query
def severity_summary_levels(spark, sf):
    return D.severity_summary(sample_log(spark, sf).withColumnRenamed("app", "level"))


@query
def host_error_ranking(spark, sf):
    return D.host_error_ranking(sample_log(spark, sf))


@query
def detect_slow_queries(spark, sf):
    return D.detect_slow_queries(sample_log(spark, sf), 100)


@query
def detect_http_errors(spark, sf):
    return D.detect_http_errors(sample_log(spark, sf))


@query
def detect_numeric_anomalies(spark, sf):
    return D.detect_numeric_anomalies(sample_log(spark, sf))


@query
def anomaly_clusters(spark, sf):
    return D.anomaly_clusters(sample_log(spark, sf))


# --- saturation -------------------------------------------------------------

@query
def detect_thread_exhaustion(spark, sf):
    return S.detect_thread_exhaustion(sample_log(spark, sf))


@query
def detect_socket_backlog(spark, sf):
    return S.detect_socket_backlog(sample_log(spark, sf))


@query
def detect_gc_pressure(spark, sf):
    return S.detect_gc_pressure(sample_log(spark, sf))


@query
def detect_thread_count_growth(spark, sf):
    return S.detect_thread_count_growth(sample_log(spark, sf), 3600, 1.5)


@query
def correlate_latency_load(spark, sf):
    return S.correlate_latency_load(sample_log(spark, sf), 3600)


@query
def saturation_host_ranking(spark, sf):
    return S.saturation_host_ranking(sample_log(spark, sf))


@query
def saturation_verdict(spark, sf):
    return S.saturation_verdict(sample_log(spark, sf))


# --- normalisation ----------------------------------------------------------

def text_times(spark, sf) -> DataFrame:
    """Log lines whose time is text in one of several forms, some of them not readable."""
    log = sample_log(spark, sf)
    us = F.unix_micros("time")
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+00:00"), F.lit("+0000")), (F.col("seq") % 3 + 1).cast("int"))
    iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
    return log.withColumn(
        "_time",
        F.when(F.col("seq") % 7 == 0, F.concat((us / F.lit(1000000)).cast("bigint").cast("string"), F.lit(".5")))
        .when(F.col("seq") % 7 == 1, F.concat(iso, zone))
        .when(F.col("seq") % 7 == 2, F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone))
        .when(F.col("seq") % 7 == 3, F.date_format("time", "MM/dd/yyyy HH:mm:ss"))
        .when(F.col("seq") % 7 == 4, iso)
        .when(F.col("seq") % 7 == 5, F.lit("None"))
        .otherwise(F.concat((us / F.lit(1000000)).cast("bigint").cast("string"), F.lit("d"))),
    ).drop("time")


@query
def extract_timestamps(spark, sf):
    return N.extract_timestamps(text_times(spark, sf)).select("seq", "_time", "time")


@query
def extract_cert_fields(spark, sf):
    log = sample_log(spark, sf).select(
        "seq",
        F.when(F.col("_raw").contains("OCSP"), "timeout").alias("ocsp_status"),
        F.when(F.col("_raw").contains("handshake"), F.col("_raw")).alias("tls_error"),
    )
    return N.extract_cert_fields(log).select("seq", "cert.*")


@query
def build_timeline(spark, sf):
    return N.build_timeline(sample_log(spark, sf)).select("seq", "time", "relative_offset_s")


@query
def prepare_events(spark, sf):
    return N.prepare_events(text_times(spark, sf)).select("seq", "time", "relative_offset_s")


def mixed_hosts(spark, sf) -> DataFrame:
    return sample_log(spark, sf).select(
        "seq", "time",
        F.when(F.col("seq") % 5 < 2, F.col("host")).when(F.col("seq") % 5 == 2, "").alias("host"),
        F.when(F.col("seq") % 5 == 3, F.col("app")).alias("src"),
        F.when(F.col("seq") % 10 == 4, F.col("source")).alias("hostname"),
    )


@query
def effective_host(spark, sf):
    return N.effective_host(mixed_hosts(spark, sf)).select("seq", "effective_host")


@query
def group_by_host(spark, sf):
    return N.group_by_host(mixed_hosts(spark, sf))


@query
def append_events(spark, sf):
    log = sample_log(spark, sf)
    slow = log.where("duration_ms > 100").select("seq", "time", "host", "duration_ms")
    http = log.where("status >= 400").select("seq", "time", "host", "status", "uri")
    return N.append_events(slow, http)


# --- follow-up areas --------------------------------------------------------

ASK = A.FollowUp(
    hosts=tuple(f"web-{i:02d}" for i in range(9)), error_codes=("E1", "E2", "E3"), sourcetype="app:error",
    spike_start=datetime(2024, 1, 10, 6, 30, tzinfo=timezone.utc),
)


@query
def area_api_errors(spark, sf):
    return A.area_api_errors(sample_log(spark, sf), ASK)


@query
def area_database_slowdown(spark, sf):
    return A.area_database_slowdown(sample_log(spark, sf), replace(ASK, sourcetype="*"), 50)


@query
def area_cascading_failure(spark, sf):
    return A.area_cascading_failure(sample_log(spark, sf), ASK)


@query
def transaction(spark, sf):
    return transaction_operator(sample_log(spark, sf), "host", 3600)


@query
def area_host_isolation(spark, sf):
    return A.area_host_isolation(sample_log(spark, sf), ASK)


@query
def area_timeline(spark, sf):
    return A.area_timeline(sample_log(spark, sf), ASK)


@query
def timeline_chart(spark, sf):
    return A.timeline_chart(sample_log(spark, sf), ASK)


@query
def area_first_occurrence(spark, sf):
    return A.area_first_occurrence(sample_log(spark, sf), ASK)


@query
def area_dispatch(spark, sf):
    return content(A.area_dispatch(sample_log(spark, sf), [*A.AREAS, "nowhere", " "], ASK))


@query
def error_filter(spark, sf):
    log = sample_log(spark, sf)
    return log.where(A.error_filter(log, ("E1", "E2"))).select("seq", "error_code")


# --- findings ---------------------------------------------------------------

PARAMS = Params(spike_window_seconds=3600, spike_threshold=25, slow_threshold_ms=100,
                pair_patterns=(PairPattern("host", "ocsp", "handshake failed", 86400),))


def bundle(spark, sf):
    log = sample_log(spark, sf)
    found = P.build_findings(log, PARAMS)
    found["event_pairs"] = D.detect_event_pair_patterns(log, PARAMS.pair_patterns)
    return found


@query
def event_count(spark, sf):
    return P.event_count(sample_log(spark, sf))


@query
def build_findings(spark, sf):
    return content(P.build_findings(sample_log(spark, sf), PARAMS))


@query
def shared_findings(spark, sf):
    """The long form from one pass through the text."""
    found = P.findings_long(P.shared_findings(sample_log(spark, sf), PARAMS))
    return found.groupBy("type", "severity", "host").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_counts(spark, sf):
    return P.findings_counts(bundle(spark, sf))


@query
def findings_long(spark, sf):
    found = P.findings_long(bundle(spark, sf))
    return found.groupBy("type", "severity", "host").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_json(spark, sf):
    found = bundle(spark, sf)
    return content_of_json(found, P.findings_json(found), P.JSON_OPTIONS)


@query
def run_summary(spark, sf):
    return P.run_summary(bundle(spark, sf))


@query
def findings_digest(spark, sf):
    return P.findings_digest(bundle(spark, sf))


@query
def findings_report(spark, sf):
    return P.findings_report(bundle(spark, sf)).select("section", "part", "line")


@query
def analyze_events(spark, sf):
    found, _ = P.analyze_events(text_times(spark, sf), PARAMS)
    return content(found)


@query
def grow_investigation(spark, sf):
    """Three steps whose events lie between one another in time; earlier events are not read again."""
    log = text_times(spark, sf)
    state = investigate(N.prepare_events(log.where("seq % 3 = 0")), PARAMS)
    for step in (1, 2):
        _, state, found = state.grow(log.where(F.col("seq") % 3 == step))
    return content(found)


# --- history ----------------------------------------------------------------

def past_queries(spark, sf) -> DataFrame:
    """Orders as the table of past queries."""
    o = table(spark, sf, "orders")
    area = F.lower(F.regexp_extract("o_orderpriority", r"-(\w+)", 1))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("iteration"),
        area.alias("area"),
        F.concat(F.lit("index=main status="), "o_orderstatus").alias("spl"),
        (F.col("o_orderstatus") != "P").alias("executed"),
        F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("bigint")).alias("result_rows"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def reports(spark, sf) -> DataFrame:
    """Conversations as reports; every turn is a report of the run, with or without a confidence."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("High", "medium", "LOW", "none")]),
                         ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 3600 + F.col("conv_id") % 5).alias("created_at"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")).alias("source_file"),
        F.concat(F.lit("## Report\n**Confidence:** "), level, F.lit("\n"), F.col("text")).alias("report_md"),
        F.lit("index=main").alias("spl"), F.lit("-24h").alias("earliest"), F.lit("now").alias("latest"),
    )


@query
def query_examples_recent(spark, sf):
    return H.query_examples_recent(past_queries(spark, sf), "urgent")


@query
def query_examples_effective(spark, sf):
    return H.query_examples_effective(past_queries(spark, sf))


@query
def query_area_stats(spark, sf):
    return H.query_area_stats(past_queries(spark, sf))


@query
def run_queries(spark, sf):
    return H.run_queries(past_queries(spark, sf), "run-7")


@query
def parse_query_blocks(spark, sf):
    blocks = past_queries(spark, sf).select(
        "id", F.when(F.col("id") % 4 == 0, F.col("spl")).otherwise(
            F.concat(F.lit("\n-- "), "area", F.lit("\n"), "spl", F.lit("\n"))).alias("block"))
    return H.parse_query_blocks(blocks).select("id", "area", "spl")


@query
def run_history(spark, sf):
    return H.run_history(reports(spark, sf))


@query
def run_detail(spark, sf):
    return H.run_detail(reports(spark, sf), past_queries(spark, sf))


@query
def confidence_flag(spark, sf):
    return reports(spark, sf).select("id", H.confidence_flag(F.col("report_md")).alias("confidence"))


def alert_history(spark, sf) -> tuple[DataFrame, DataFrame]:
    """HTTP errors as stored alerts; every third one is acknowledged."""
    errors = sample_log(spark, sf).where("status >= 400")
    alerts = errors.select(
        F.col("seq").cast("string").alias("alert_id"), F.lit("watch").alias("run_id"), F.col("time").alias("ts"),
        F.when(F.col("status") >= 500, "critical").otherwise("warning").alias("severity"),
        F.concat(F.lit("HTTP "), F.col("status").cast("string")).alias("summary"), F.lit("{}").alias("detail_json"))
    return alerts, errors.where("seq % 3 = 0").select(F.col("seq").cast("string").alias("alert_id"))


@query
def alerts_open(spark, sf):
    return H.alerts_open(*alert_history(spark, sf), severity="critical")


@query
def alerts_ack(spark, sf):
    """The twenty oldest alerts are acknowledged in two rounds, one of them twice."""
    root, (alerts, _) = scratch(spark), alert_history(spark, sf)
    oldest = [r["alert_id"] for r in alerts.orderBy("ts", "alert_id").limit(20).select("alert_id").collect()]
    tables.alerts_ack(spark, root, oldest[:12])
    tables.alerts_ack(spark, root, oldest[11:])
    acks = tables.read_acks(spark, root)
    seen = H.alerts_open(alerts, acks).unionByName(H.alerts_open(alerts, acks, acked=True))
    return seen.groupBy("severity", "summary", "acked").agg(F.count(F.lit(1)).alias("n"))


def run_log(spark, sf) -> DataFrame:
    """Orders as the log of run updates; each row updates only some fields, some rows clear the run."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), (F.col("o_custkey") % 50).cast("string")).alias("run_id"),
        k.alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (k % 97 == 0).alias("cleared"),
        F.when(k % 5 == 0, F.col("o_orderpriority")).alias("source"),
        F.when(k % 2 == 0, (k % 4).cast("int")).alias("iteration"),
        F.when(k % 3 == 0, F.col("o_orderstatus")).alias("confidence"),
        F.when(k % 7 == 0, k).alias("events"),
    )


@query
def latest_run_status(spark, sf):
    return H.latest_run_status(run_log(spark, sf))


@query
def latest_run_status_by_id(spark, sf):
    return H.latest_run_status(run_log(spark, sf), "run-7")


@query
def investigation_status(spark, sf):
    steps = reports(spark, sf).select(
        "id", F.col("report_md").alias("report"), (F.col("id") % 100 % 4 + 1).cast("int").alias("iteration"),
        (F.col("id") % 3).alias("n_queries"), (F.col("id") % 7).alias("n_new"))
    return H.investigation_status(steps).select("id", "confidence", "status")


# --- sources and sinks ------------------------------------------------------

def scratch(spark) -> str:
    return f"{scratch_root(spark)}/check-{uuid.uuid4().hex}"


def export(spark, sf, form: str) -> str:
    """The log with its time as text, written as one JSON export (an envelope or a list), as lines, or as CSV."""
    path, log = scratch(spark), sample_log(spark, sf)
    log = log.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if form == "csv":
        log.write.option("header", True).option("escape", '"').csv(path)
        return path
    body = F.to_json(F.struct(*log.columns))
    if form == "lines":
        log.select(body).write.text(path)
        return path
    opening, closing = ('{"took": 3, "results": [', "]}") if form == "envelope" else ("[", "]")
    last = log.agg(F.max("seq")).scalar()
    lines = log.select("seq", F.concat(body, F.when(F.col("seq") < last, ",").otherwise("")).alias("line"))
    ends = spark.createDataFrame([(-1, opening), (1 << 60, closing)], "seq bigint, line string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("seq").select("line").write.text(path)
    return path


@query
def read_events_json(spark, sf):
    """An envelope and a list, with all fields."""
    return readers.read_events_json(spark, export(spark, sf, "envelope")).withColumn("form", F.lit("envelope")).unionByName(
        readers.read_events_json(spark, export(spark, sf, "list")).withColumn("form", F.lit("list")))


@query
def read_events_lines(spark, sf):
    """Lines whose nested fields drift from a schema: what does not fit is kept as text."""
    path, k = scratch(spark), F.col("active_threads")
    body = F.concat(
        F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"d":{"k":'),
        F.when(k % 5 == 0, F.concat(F.lit('"'), k.cast("string"), F.lit('x"'))).otherwise(k.cast("string")),
        F.when(k % 7 == 0, F.lit(',"fresh":[1]')).otherwise(""), F.lit("}}"))
    sample_log(spark, sf).select(body).write.text(path)
    found = readers.read_events_lines(spark, path, "seq bigint, d struct<k:bigint>")
    return found.select("seq", F.col("d.k").alias("k"), F.element_at("extra", "d").alias("kept"))


@query
def read_events_csv(spark, sf):
    return readers.read_events_csv(spark, export(spark, sf, "csv"))


@query
def read_events(spark, sf):
    """Every form told by its content: all fields of lines, and the counts of the others."""
    lines = readers.read_events(spark, export(spark, sf, "lines")).withColumn("form", F.lit("lines"))
    parts = [lines.select("form", "seq", "time", "host", "status", "duration_ms", "_raw")]
    for form in ("envelope", "list", "csv"):
        found = readers.read_events(spark, export(spark, sf, form))
        parts.append(found.select(F.lit(form).alias("form"), F.col("seq").cast("bigint"), "time", "host",
                                  F.col("status").cast("bigint"), F.col("duration_ms").cast("double"), "_raw"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def read_records(spark, sf):
    path = f"{scratch(spark)}.csv"
    log = sample_log(spark, sf).select("seq", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "host",
                                       "active_threads", "duration_ms")
    log.write.option("header", True).csv(path)
    return readers.read_records(spark, path)


@query
def scan_events(spark, sf):
    path = scratch(spark)
    readers.write_event_table(sample_log(spark, sf), path)
    return readers.scan_events(spark, path, datetime(2024, 1, 12, 12, tzinfo=timezone.utc), "-36h", "-6h",
                               sourcetypes=["app:error"]).select("seq", "time", "host", "status")


@query
def relative_time(spark, sf):
    """Events per look-back window before a fixed moment."""
    now = datetime(2024, 1, 12, 12, tzinfo=timezone.utc)
    time = F.col("time")
    counts = [
        F.count_if((time >= F.lit(relative(m, now))) & (time < F.lit(now))).alias(name)
        for m, name in (("-24h", "day"), ("-15m", "quarter"), ("2024-01-02T00:00:00Z", "since"))
    ]
    return sample_log(spark, sf).agg(*counts)


@query
def write_events(spark, sf):
    root = scratch(spark)
    tables.write_events(sample_log(spark, sf).withColumn("_time", F.col("seq").cast("string")), root, "run-1")
    stored = spark.read.parquet(f"{root}/events")
    return stored.select("run_id", "_time", "host", "app", F.get_json_object("extra_json", "$.uri").alias("uri"),
                         F.get_json_object("extra_json", "$.status").cast("int").alias("status"))


@query
def load_run_events(spark, sf):
    root = scratch(spark)
    log = sample_log(spark, sf).withColumn("_time", F.col("seq").cast("string"))
    tables.write_events(log, root, "run-1")
    tables.write_events(log.where("seq < 10"), root, "run-2")
    return tables.load_run_events(spark, root, "run-1", "seq bigint, duration_ms double, error_code string").select(
        "_time", "host", "_raw", "seq", "duration_ms", "error_code")


@query
def write_findings(spark, sf):
    root = scratch(spark)
    found = bundle(spark, sf)
    tables.write_findings(found, root, "run-1")
    stored = spark.read.parquet(f"{root}/findings").where("run_id = 'run-1'")
    return content_of_json({k: v for k, v in found.items() if k not in P.SINGLE}, stored, P.JSON_OPTIONS)


@query
def write_report(spark, sf):
    """A report stored as rows, read back from the history with its confidence."""
    root, lines = scratch(spark), P.findings_report(bundle(spark, sf))
    number = tables.write_report(spark, root, "run-1", lines)
    history = tables.read_table(spark, root, "reports", tables.REPORT_SCHEMA).where(F.col("id") == number)
    level = history.agg(F.max(H.confidence_flag(F.col("report_md")))).scalar()
    return tables.read_report(spark, root, "run-1", number).select("section", "part", "line", level.alias("confidence"))


@query
def write_queries(spark, sf):
    """Query blocks of two runs, written per iteration with the rows each had."""
    root = scratch(spark)
    done = past_queries(spark, sf).where("run_id in ('run-7', 'run-8')").groupBy("run_id", "iteration", "area").count()
    for run_id, iteration in sorted({(r["run_id"], r["iteration"]) for r in done.collect()}):
        rows = done.where((F.col("run_id") == run_id) & (F.col("iteration") == iteration)).orderBy("area").collect()
        tables.write_queries(spark, root, run_id, iteration, [f"-- {r['area']}\nindex=main" for r in rows],
                             [r["count"] for r in rows])
    stored = spark.read.parquet(f"{root}/investigation_queries")
    return stored.select("run_id", "iteration", "area", "spl", "executed", "result_rows")


@query
def write_alerts(spark, sf):
    root = scratch(spark)
    hits = W.tag_http(D.http_rows(sample_log(spark, sf)))
    tables.write_alerts(hits, root, "watch")
    return tables.read_alerts(spark, root).groupBy("run_id", "severity", "summary").agg(F.count(F.lit(1)).alias("n"))


# --- schema catalogue -------------------------------------------------------

def observed(spark, sf) -> DataFrame:
    """JSON bodies whose value is a number, a text, a list or absent, by event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = table(spark, sf, "events").withColumn("k", k)
    body = F.when(F.col("k") % 50 == 0, F.concat(F.lit('{"k": ["'), F.col("k"), F.lit('"], "tag": "x"}'))).when(
        F.col("k") % 9 == 0, F.concat(F.lit('{"k": "'), F.col("k"), F.lit('", "ratio": 0.5e0}'))).otherwise(F.col("props"))
    return catalog.observe_json(events.withColumn("body", body), "body", "event_type", "ts")


@query
def schema_catalog_upsert(spark, sf):
    early, late = observed(spark, sf), catalog.observe_columns(
        table(spark, sf, "events").withColumnRenamed("event_type", "sourcetype"), "ts")
    return catalog.schema_catalog_upsert(early, late)


@query
def schema_catalog_reset(spark, sf):
    seen = catalog.schema_catalog_upsert(None, observed(spark, sf))
    fresh = catalog.observe_columns(table(spark, sf, "events").withColumnRenamed("event_type", "sourcetype"), "ts")
    return catalog.schema_catalog_reset(seen, fresh, ["click", "view"])


@query
def schema_catalog_load(spark, sf):
    path = scratch(spark)
    log = sample_log(spark, sf)
    catalog.write_catalog(catalog.schema_catalog_upsert(None, catalog.observe_columns(log)), path)
    schema = catalog.schema_catalog_load(catalog.read_catalog(spark, path), "app:error")
    lines = f"{path}-lines"
    log.where("sourcetype = 'app:error'").write.json(lines)
    return readers.read_events_json(spark, lines, schema, lines=True).select("seq", "host", "status", "duration_ms")


@query
def schema_drift(spark, sf):
    return catalog.schema_drift(observed(spark, sf))


# --- streaming --------------------------------------------------------------

def log_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return log_columns(W.stream_source(spark, sf, schema, time_column="ts", pathGlobFilter="events.parquet"))


def drained(spark, stream, mode="append") -> DataFrame:
    path = scratch(spark)
    W.run_to_table(stream, path, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def tag_alerts(spark, sf):
    return W.tag_alerts(sample_log(spark, sf), PARAMS).select("detector", "severity", "summary")


@query
def stream_row_alerts(spark, sf):
    return drained(spark, W.stream_row_alerts(log_stream(spark, sf), PARAMS)).select("detector", "severity", "summary")


@query
def stream_source(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = W.stream_source(spark, sf, schema, time_column="ts", pathGlobFilter="events.parquet",
                             started=datetime(2024, 1, 20, tzinfo=timezone.utc), lookback="-15m")
    return drained(spark, stream).select("event_id", "ts", "event_type")


def log_parts(spark, sf, until=("2024-01-08", "2024-01-20", "2025-01-01")) -> Iterator[DataFrame]:
    """The log as a stream that grows in the order of time: each run of it finds the files of one more stretch."""
    path, log, start = scratch(spark), sample_log(spark, sf), "2000-01-01"
    for end in until:
        log.where((F.col("time") >= start) & (F.col("time") < end)).write.mode("append").parquet(path)
        start = end
        yield W.stream_source(spark, path, log.schema)


def drained_parts(spark, sf, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has appended after a run, from its checkpoint, for every part of the log."""
    path = scratch(spark)
    for stream in map(build, log_parts(spark, sf)):
        W.run_to_table(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_spikes(spark, sf):
    return drained_parts(spark, sf, lambda log: stateful.stream_spikes(log, 3600, 20))


@query
def stream_spikes_grid(spark, sf):
    return drained(spark, W.stream_spikes(log_stream(spark, sf), 3600, 20), "complete")


@query
def stream_patterns(spark, sf):
    return drained_parts(spark, sf, lambda log: stateful.stream_patterns(log, 86400))


@query
def stream_patterns_complete(spark, sf):
    return drained(spark, W.stream_patterns(log_stream(spark, sf), 86400), "complete")


@query
def stream_sessions(spark, sf):
    return drained_parts(spark, sf, lambda log: stateful.stream_sessions(log, 60))


@query
def stream_sessions_keyed(spark, sf):
    return drained(spark, W.stream_sessions(log_stream(spark, sf)), "complete")


@query
def stream_overlap(spark, sf):
    """Polls that read the last day of the one before again; every event comes out once."""
    path, log = scratch(spark), sample_log(spark, sf)
    for start, end in (("2000-01-01", "2024-01-08"), ("2024-01-07", "2024-01-20"), ("2024-01-19", "2025-01-01")):
        log.where((F.col("time") >= start) & (F.col("time") < end)).coalesce(1).write.mode("append").parquet(path)
    stream = W.without_repeats(W.stream_source(spark, path, log.schema, maxFilesPerTrigger="1"), ["seq"], 2 * 86400)
    return drained(spark, stream).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("events"), F.sum("seq").alias("total"))


@query
def watch_cycles(spark, sf):
    """Alerts of single events over three cycles of the watch loop, one by one although some are equal."""
    root = scratch(spark)
    for stream in log_parts(spark, sf):
        W.start_watch(stream, root, "watch", PARAMS, once=True).awaitTermination()
    found = tables.read_alerts(spark, root).where(~F.col("summary").rlike("^(Spike|Repeated)"))
    return found.groupBy("severity", "summary").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_cycle_guard(spark, sf):
    root = scratch(spark)
    W.start_watch(log_stream(spark, sf), root, "watch", PARAMS, once=True).awaitTermination()
    return tables.read_alerts(spark, root).groupBy("severity", "summary").agg(F.count(F.lit(1)).alias("n"))
