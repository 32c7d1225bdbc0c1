"""Assembly of findings: the bundle of detector results and everything derived from it.

A bundle is a dict of frames. The prepared events are not cached: every detector reads a few
columns, so a columnar scan per detector costs less than holding the whole table on executors. The
raw text, by far the widest column, can be read once for all detectors (``share``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import (
    DEFAULTS,
    DURATION_FIELDS,
    ERROR_CODE_FIELDS,
    HOST_FIELDS,
    LEVEL_FIELDS,
    NUMERIC_FIELDS,
    QUERY_FIELDS,
    SEVERITY_LEVELS,
    Params,
)
from eventloom.functions import first_present, micros, optional, or_unknown, row_order, to_double
from eventloom.functions.text import iso_text, two_decimals
from eventloom.operators import detectors as D
from eventloom.operators.normalize import append_events, prepare_events
from eventloom.session import materialize

Findings = dict[str, DataFrame]

# JSON bodies keep all digits of a time
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# bundle entries that are not lists of findings
SINGLE = ("severity", "event_count")

# a digest names so many levels at most
TOP_LEVELS = 99


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("event_count"))


def build_findings(events: DataFrame, params: Params = DEFAULTS, share: bool = True) -> Findings:
    """The detectors of one investigation step over prepared events.

    The raw text is read once (see ``shared_findings``) unless ``share`` is off, when each detector scans for itself.
    """
    if share and "_raw" in events.columns:
        return shared_findings(events, params, with_pairs=False)
    return {
        "spikes": D.detect_spikes(events, params.spike_window_seconds, params.spike_threshold),
        "patterns": D.detect_patterns(events),
        "cert_anomalies": D.detect_cert_anomalies(events, params.cert_keywords),
        "correlations": D.correlate_events(events, params.correlate_window_seconds),
        "severity": D.severity_summary(events),
        "host_ranking": D.host_error_ranking(events),
        "slow_queries": D.detect_slow_queries(events, params.slow_threshold_ms),
        "numeric_anomalies": D.detect_numeric_anomalies(
            events, window=params.anomaly_window, z_threshold=params.anomaly_z_threshold),
        "event_count": event_count(events),
    }


def analyze_events(raw_events: DataFrame, params: Params = DEFAULTS, share: bool = True
                   ) -> tuple[Findings, DataFrame]:
    """Normalise raw events, run all detectors including event pairs, and lay out the report."""
    events = prepare_events(raw_events)
    if share and "_raw" in events.columns:
        findings = shared_findings(events, params)
    else:
        findings = build_findings(events, params)
        findings["event_pairs"] = D.detect_event_pair_patterns(events, params.pair_patterns)
    return findings, findings_report(findings)


def text_facts(events: DataFrame, params: Params) -> DataFrame:
    """Narrow rows in place of the raw text: what each detector wants to know of it.

    Long pieces of text are kept only for the lines that will show them.
    """
    keep = ("time", "sourcetype", *HOST_FIELDS, *ERROR_CODE_FIELDS, *LEVEL_FIELDS, *DURATION_FIELDS, *NUMERIC_FIELDS)
    columns = [F.col(f"`{c}`") for c in dict.fromkeys(keep) if c in events.columns]
    raw = F.col("_raw").cast("string")
    cert = D.cert_keywords_in(events, params.cert_keywords)
    wanted = D.usable_pairs(events, params.pair_patterns)
    duration = first_present(events, DURATION_FIELDS)
    slow = to_double(events, duration) > params.slow_threshold_ms if duration else F.lit(False)
    shown = optional(events, first_present(events, QUERY_FIELDS)).cast("string")
    pair_type = "array<struct<rule:int,opens:boolean,entity:string>>"
    return events.select(
        *columns,
        row_order(events).alias("seq"),
        F.substring(raw, 1, 60).alias("line_start"),
        F.array(*D.level_tests(raw)).alias("level_words"),
        cert.alias("cert_words"),
        F.when(F.size(cert) > 0, F.substring(F.coalesce(raw, F.lit("")), 1, 120)).alias("cert_excerpt"),
        (D.pair_hits(events, wanted) if wanted else F.lit(None).cast(pair_type)).alias("pair_hits"),
        F.when(F.size(D.pair_hits(events, wanted)) > 0, F.substring(raw, 1, 120)).alias("pair_excerpt")
        if wanted else F.lit(None).cast("string").alias("pair_excerpt"),
        F.when(slow, F.substring(shown, 1, 200)).alias("query"),
    )


def shared_findings(events: DataFrame, params: Params = DEFAULTS, with_pairs: bool = True) -> Findings:
    """All detectors over one pass through the raw text.

    The pass writes the narrow facts as a table; the detectors read their columns of it.
    """
    facts = materialize(text_facts(events, params), "facts")
    words = [F.get("level_words", i) for i in range(len(SEVERITY_LEVELS))]
    is_error = words[SEVERITY_LEVELS.index("ERROR")] | words[SEVERITY_LEVELS.index("CRITICAL")]
    findings = {
        "spikes": D.detect_spikes(facts, params.spike_window_seconds, params.spike_threshold),
        "patterns": D.detect_patterns(facts.withColumnRenamed("line_start", "_raw")),
        "cert_anomalies": facts.where(F.size("cert_words") > 0).select(
            F.lit("cert_anomaly").alias("type"), or_unknown(optional(facts, "host")).alias("host"),
            optional(facts, "time", "timestamp").alias("time"), F.col("cert_words").alias("matched_keywords"),
            or_unknown(optional(facts, "sourcetype")).alias("sourcetype"), F.col("cert_excerpt").alias("raw_excerpt")),
        "correlations": D.correlate_events(facts, params.correlate_window_seconds),
        "severity": D.severity_summary(facts, words),
        "host_ranking": D.host_error_ranking(facts, is_error),
        "slow_queries": D.detect_slow_queries(facts, params.slow_threshold_ms),
        "numeric_anomalies": D.detect_numeric_anomalies(
            facts, window=params.anomaly_window, z_threshold=params.anomaly_z_threshold),
        "event_count": event_count(facts),
    }
    wanted = D.usable_pairs(events, params.pair_patterns) if with_pairs else []
    if wanted:
        hits = facts.where(F.col("time").isNotNull() & (F.size("pair_hits") > 0)).select(
            F.explode("pair_hits").alias("hit"),
            F.struct(micros(F.col("time")).alias("us"), "seq", F.col("pair_excerpt").alias("excerpt")).alias("line"),
        ).select("hit.*", "line")
        findings["event_pairs"] = D.pairs_from_hits(hits, wanted)
    elif with_pairs:
        findings["event_pairs"] = D.detect_event_pair_patterns(facts, params.pair_patterns)
    return findings


def findings_long(findings: Findings) -> DataFrame:
    """One row per finding: type, severity (or the finding's own type), host, JSON body."""
    parts = [
        found.select(
            F.lit(kind).alias("type"),
            _first_text(found, ("severity", "type")).alias("severity"),
            _first_text(found, ("host",)).alias("host"),
            F.to_json(F.struct("*"), JSON_OPTIONS).alias("body_json"),
        )
        for kind, found in findings.items()
        if kind not in SINGLE
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _first_text(found: DataFrame, names: tuple[str, ...]) -> Column:
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in found.columns]
    return F.coalesce(*present, F.lit(""))


def findings_json(findings: Findings) -> DataFrame:
    """The whole bundle as JSON rows, with the severity counts and the event count."""
    single = [
        findings[kind].select(F.lit(kind).alias("type"), F.to_json(F.struct("*"), JSON_OPTIONS).alias("body_json"))
        for kind in SINGLE
        if kind in findings
    ]
    out = findings_long(findings).select("type", "body_json")
    for part in single:
        out = out.unionByName(part)
    return out


def findings_counts(findings: Findings) -> DataFrame:
    """Number of findings per type, zero included."""
    parts = [
        found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("type"), "n")
        for kind, found in findings.items()
        if kind not in SINGLE
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_summary(findings: Findings) -> DataFrame:
    """One row: number of findings, CRITICAL and ERROR counts, the host with most errors."""
    counted = ("spikes", "cert_anomalies", "patterns", "slow_queries", "numeric_anomalies", "event_pairs")
    n_findings = findings_counts({k: v for k, v in findings.items() if k in counted})

    def level(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("level") == name, F.col("count"))), F.lit(0)).cast("bigint")

    top = findings["host_ranking"].orderBy(F.desc("error_count"), "host").limit(1)
    top = top.agg(F.max("host").alias("host")).scalar()
    return n_findings.agg(F.sum("n").alias("n_findings")).select(
        "n_findings",
        findings["severity"].agg(level("CRITICAL").alias("n")).scalar().alias("critical"),
        findings["severity"].agg(level("ERROR").alias("n")).scalar().alias("error"),
        F.coalesce(top, F.lit("n/a")).alias("top_error_host"),
    )


def findings_digest(findings: Findings, top: int = 3) -> DataFrame:
    """The number of findings and the first three of each kind as text, in the order of ``section`` and ``place``; kinds
    without findings have no lines. Each kind is a top-k of its own, so no kind is ever gathered in one place."""
    patterns = findings["patterns"].orderBy(
        F.asc("type"), F.desc("count"), "sourcetype", "error_code", "prefix").limit(top).where(F.col("type") == "repeated_error")
    # per kind: its heading, its shown rows, their order, their text
    kinds: list[tuple[str, Column | str, DataFrame, list, Column]] = [
        ("spikes", "spike(s)", findings["spikes"], [F.col("window_start")],
         F.concat(iso_text(F.col("window_start")), F.lit(" — "), F.col("event_count").cast("string"), F.lit(" events in "),
                  F.col("window_seconds").cast("string"), F.lit("s on hosts: "), F.array_join("hosts", ", "))),
        # repeated errors come before prefixes, and only they are shown
        ("patterns", "repeated pattern(s)", patterns, [F.desc("count"), F.col("sourcetype"), F.col("error_code")],
         F.concat(F.coalesce("sourcetype", F.lit("None")), F.lit(" / error "), F.coalesce("error_code", F.lit("None")),
                  F.lit(" — "), F.col("count").cast("string"), F.lit("x"))),
        ("cert_anomalies", "certificate event(s)", findings["cert_anomalies"],
         [F.asc_nulls_last("time"), F.col("host"), F.col("raw_excerpt")],
         F.concat(F.lit("["), "host", F.lit("] "), F.array_join("matched_keywords", ", "), F.lit(" at "),
                  F.coalesce(iso_text(F.col("time")), F.lit("None")))),
        ("severity", "severity level(s)", findings["severity"], [F.desc("count"), F.col("level")],
         F.concat(F.coalesce("level", F.lit("None")), F.lit(": "), F.col("count").cast("string"))),
        ("host_ranking", "host(s) with errors", findings["host_ranking"], [F.desc("error_count"), F.col("host")],
         F.concat(F.coalesce("host", F.lit("None")), F.lit("("), F.col("error_count").cast("string"), F.lit(")"))),
    ]
    parts = []
    for section, (kind, title, rows, order, line) in enumerate(kinds, 1):
        of_kind = (F.lit(section).alias("section"), F.lit(kind).alias("type"))
        head = findings[kind].agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        parts.append(head.select(*of_kind, F.lit(0).alias("place"), F.concat(F.col("n").cast("string"), F.lit(f" {title}")).alias("line")))
        # the few rows of a top-k are one sorted partition, in which row numbers are places
        placed = rows.orderBy(*order).limit(TOP_LEVELS if kind == "severity" else top).withColumn(
            "place", (F.monotonically_increasing_id() + 1).cast("int"))
        parts.append(placed.select(*of_kind, "place", line.alias("line")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("section", "place")


def findings_report(findings: Findings) -> DataFrame:
    """The report as ordered lines (``section, heading, rank, tie, line``), complete in every section.

    Write it with ``.select("line").write.text``; read it whole only when it is known to be small.
    """
    def section(number: int, found: DataFrame | None, title: Column | str, rank: Column, tie: Column, line: Column,
                top: int | None = None) -> list[DataFrame]:
        if found is None:
            return []
        shown = found.select(rank.cast("double").alias("rank"), tie.cast("string").alias("tie"), line.alias("line"))
        if top is not None:
            shown = shown.orderBy("rank", "tie").limit(top)
        if isinstance(title, str):
            head = found.sparkSession.range(1).select(F.lit(title).alias("line"))
        else:
            head = found.agg(title.alias("line"))
        return [
            head.select(F.lit(number).alias("section"), F.lit(0).alias("part"), F.lit(0.0).alias("rank"),
                        F.lit("").alias("tie"), "line"),
            shown.select(F.lit(number).alias("section"), F.lit(1).alias("part"), "rank", "tie", "line"),
        ]

    def titled(name: str) -> Column:
        return F.concat(F.lit(f"## {name} ("), F.count(F.lit(1)).cast("string"), F.lit(")"))

    text = F.concat
    when_us = F.unix_micros
    bracket_host = F.coalesce(text(F.lit(" ["), F.col("host"), F.lit("]")), F.lit(""))
    lines: list[DataFrame] = []
    lines += section(
        0, findings["severity"], "# Findings", F.lit(1.0), F.col("level"),
        text(F.lit("**Severity** "), F.coalesce("level", F.lit("None")), F.lit(": "), F.col("count").cast("string")))
    lines += section(
        1, findings["event_count"], "## Events analysed", F.lit(0.0), F.lit(""),
        F.col("event_count").cast("string"))
    lines += section(
        2, findings["spikes"], titled("Spikes"), when_us("window_start"), F.lit(""),
        text(F.lit("- "), iso_text(F.col("window_start")), F.lit(" — "), F.col("event_count").cast("string"),
             F.lit(" events on "), F.array_join("hosts", ", ")))
    lines += section(
        3, findings["cert_anomalies"], titled("Cert Anomalies"), when_us("time"), F.col("host"),
        text(F.lit("- ["), "host", F.lit("] "), F.array_join("matched_keywords", ", "), F.lit(" at "),
             F.coalesce(iso_text(F.col("time")), F.lit("None"))))
    lines += section(
        4, findings["host_ranking"], "## Top Error Hosts", -F.col("error_count"), F.col("host"),
        text(F.lit("- "), F.coalesce("host", F.lit("None")), F.lit(": "), F.col("error_count").cast("string"),
             F.lit(" errors")), top=5)
    lines += section(
        5, findings["slow_queries"], titled("Slow Queries"), -F.col("duration_ms"),
        text(F.coalesce(F.col("time").cast("string"), F.lit("")), F.coalesce("host", F.lit(""))),
        text(F.lit("- "), F.rint("duration_ms").cast("bigint").cast("string"), F.lit("ms"), bracket_host,
             F.lit(" — "), F.coalesce("query", F.lit(""))), top=10)
    lines += section(
        6, findings.get("event_pairs"), titled("Event Pairs"), when_us("first_time"),
        text(F.coalesce("entity", F.lit("")), "first_pattern", "second_pattern"),
        text(F.lit("- ["), F.coalesce("entity", F.lit("None")), F.lit("] '"), "first_pattern", F.lit("' at "),
             iso_text(F.col("first_time")), F.lit(" -> '"), "second_pattern", F.lit("' at "),
             iso_text(F.col("second_time")), F.lit(" (+"), F.rint("span_seconds").cast("bigint").cast("string"),
             F.lit("s)")))
    lines += section(
        7, findings["numeric_anomalies"], titled("Numeric Anomalies"), -F.abs("z_score"), F.col("time"),
        text(F.lit("- "), "field", F.lit("="), two_decimals(F.col("value")), bracket_host, F.lit(" — z="),
             two_decimals(F.col("z_score")), F.lit(" (mean="), two_decimals(F.col("rolling_mean")),
             F.lit(", std="), two_decimals(F.col("rolling_std")), F.lit(") at "), iso_text(F.col("time")),
             F.when(F.col("window_contaminated"), F.lit(" (likely window-contamination artifact)"))
             .otherwise(F.lit(""))), top=10)
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out.orderBy("section", "part", "rank", "tie", "line")


def grow_investigation(events: DataFrame, more: DataFrame | None, params: Params = DEFAULTS, share: bool = True
                       ) -> tuple[str, DataFrame, Findings | None]:
    """Add follow-up events and look again; ``done`` when there are none."""
    if more is None or more.isEmpty():
        return "done", events, None
    grown = append_events(events, prepare_events(more))
    return "continue", grown, build_findings(grown, params, share)
