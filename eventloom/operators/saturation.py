"""Signals of thread-pool and connection saturation, and the verdict drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import (
    GC_KEYWORDS,
    LATENCY_FIELDS,
    SOCKET_STATES,
    THREAD_COUNT_FIELDS,
    THREAD_EXHAUSTION_KEYWORDS,
)
from eventloom.functions import contains_any, first_present, floor_div, matched_keywords, micros, or_unknown, to_double
from eventloom.functions.columns import host_column
from eventloom.operators.detectors import CERT_SCHEMA, keyword_scan
from eventloom.operators.ordered import US, prefix
from eventloom.session import materialize

GC_SCHEMA = "type string, host string, time timestamp, matched_keywords array<string>, raw_excerpt string"
BACKLOG_SCHEMA = "type string, host string, state string, count bigint"
GROWTH_SCHEMA = (
    "type string, window_start timestamp, window_seconds int, prev_avg double, current_avg double, "
    "growth_ratio double"
)
LOAD_SCHEMA = "window_start timestamp, avg_threads double, avg_latency_ms double, event_count bigint"


def _empty(events: DataFrame, schema: str) -> DataFrame:
    return events.sparkSession.createDataFrame([], schema)


def detect_thread_exhaustion(events: DataFrame) -> DataFrame:
    if "_raw" not in events.columns:
        return _empty(events, CERT_SCHEMA)
    return keyword_scan(events, "thread_exhaustion", THREAD_EXHAUSTION_KEYWORDS, 160)


def detect_gc_pressure(events: DataFrame) -> DataFrame:
    if "_raw" not in events.columns:
        return _empty(events, GC_SCHEMA)
    return keyword_scan(events, "gc_pressure", GC_KEYWORDS, 160).drop("sourcetype")


def detect_socket_backlog(events: DataFrame, min_count: int = 5) -> DataFrame:
    """Hosts whose lines name the same socket state at least ``min_count`` times."""
    if "_raw" not in events.columns:
        return _empty(events, BACKLOG_SCHEMA)
    text = F.lower(F.col("_raw").cast("string"))
    return (
        events.where(contains_any(text, SOCKET_STATES))
        .select(or_unknown(host_column(events)).alias("host"), F.explode(matched_keywords(text, SOCKET_STATES)).alias("state"))
        .groupBy("host", "state")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
        .select(F.lit("socket_backlog").alias("type"), "host", "state", "count")
        .orderBy(F.desc("count"), "host", "state")
    )


def detect_thread_count_growth(events: DataFrame, window_seconds: int = 300, growth_ratio: float = 1.5
                               ) -> DataFrame:
    """Time buckets whose mean thread count is at least ``growth_ratio`` times that of the
    non-empty bucket before. Averages are not rounded here; the report rounds."""
    field = first_present(events, THREAD_COUNT_FIELDS)
    if field is None or "time" not in events.columns:
        return _empty(events, GROWTH_SCHEMA)
    width = window_seconds * US
    buckets = (
        events.where(F.col("time").isNotNull())
        .select(floor_div(micros(F.col("time")), width).alias("bucket"), to_double(events, field).alias("threads"))
        .where(F.col("threads").isNotNull())
        .groupBy("bucket")
        .agg(F.avg("threads").alias("current_avg"))
    )
    return _growth(buckets, window_seconds, growth_ratio)


def _growth(buckets: DataFrame, window_seconds: int, growth_ratio: float) -> DataFrame:
    """Growth between means (``bucket, current_avg``) of buckets of time."""
    width = window_seconds * US
    ratio = F.col("current_avg") / F.nullif(F.col("prev_avg"), F.lit(0.0))
    return (
        prefix(buckets, "bucket", "current_avg", "prev_avg", how="last")
        .withColumn("growth_ratio", ratio)
        .where(F.col("growth_ratio") >= growth_ratio)
        .select(
            F.lit("thread_count_growth").alias("type"),
            F.timestamp_micros(F.col("bucket") * width).alias("window_start"),
            F.lit(window_seconds).alias("window_seconds"),
            "prev_avg", "current_avg", "growth_ratio",
        )
        .orderBy("window_start")
    )


def correlate_latency_load(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Mean thread count and mean latency side by side per time bucket."""
    threads, latency = first_present(events, THREAD_COUNT_FIELDS), first_present(events, LATENCY_FIELDS)
    if threads is None or latency is None or "time" not in events.columns:
        return _empty(events, LOAD_SCHEMA)
    width = window_seconds * US
    return (
        events.where(F.col("time").isNotNull())
        .select(
            floor_div(micros(F.col("time")), width).alias("bucket"),
            to_double(events, threads).alias("threads"),
            to_double(events, latency).alias("latency"),
        )
        .where(F.col("threads").isNotNull() & F.col("latency").isNotNull())
        .groupBy("bucket")
        .agg(F.avg("threads").alias("avg_threads"), F.avg("latency").alias("avg_latency_ms"),
             F.count(F.lit(1)).alias("event_count"))
        .select(F.timestamp_micros(F.col("bucket") * width).alias("window_start"),
                "avg_threads", "avg_latency_ms", "event_count")
        .orderBy("window_start")
    )


def latency_load_correlation(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Pearson correlation of mean thread count and mean latency over the buckets, with their number."""
    return correlate_latency_load(events, window_seconds).agg(
        F.corr("avg_threads", "avg_latency_ms").alias("correlation"), F.count(F.lit(1)).alias("windows"))


def saturation_host_ranking(events: DataFrame) -> DataFrame:
    """Hosts by number of exhaustion lines."""
    return (
        detect_thread_exhaustion(events)
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("exhaustion_events"))
        .orderBy(F.desc("exhaustion_events"), "host")
    )


def saturation_verdict(events: DataFrame, window_seconds: int = 300, growth_ratio: float = 1.5, min_count: int = 5) -> DataFrame:
    """One row: five signals, their number, and the confidence (two or more: High).

    One pass over the events sums up all that the signals need per time bucket and host, and writes these few rows; the
    signals are scalar subqueries over them.
    """
    def value(names) -> Column:
        field = first_present(events, names)
        return to_double(events, field) if field else F.lit(None).cast("double")

    has_time = "time" in events.columns
    text = F.lower(F.coalesce(F.col("_raw").cast("string"), F.lit(""))) if "_raw" in events.columns else F.lit("")
    loaded = F.col("threads").isNotNull() & F.col("latency").isNotNull()
    cells = materialize(
        events.select(
            (floor_div(micros(F.col("time")), window_seconds * US) if has_time else F.lit(None).cast("bigint")).alias("bucket"),
            or_unknown(host_column(events)).alias("host"), text.alias("text"),
            value(THREAD_COUNT_FIELDS).alias("threads"), value(LATENCY_FIELDS).alias("latency"))
        .groupBy("bucket", "host")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(contains_any(F.col("text"), THREAD_EXHAUSTION_KEYWORDS)).alias("exhausted"),
            F.max(contains_any(F.col("text"), GC_KEYWORDS)).alias("collected"),
            F.sum("threads").alias("threads"), F.count("threads").alias("counted"),
            F.sum(F.when(loaded, F.col("threads"))).alias("loaded_threads"), F.count_if(loaded).alias("loaded"),
            *(F.count_if(F.contains("text", F.lit(state))).alias(f"state{i}") for i, state in enumerate(SOCKET_STATES))),
        "saturation-cells")
    buckets = cells.where("bucket is not null").groupBy("bucket").agg(
        F.try_divide(F.sum("threads"), F.sum("counted")).alias("current_avg"),
        F.try_divide(F.sum("loaded_threads"), F.sum("loaded")).alias("avg_threads"))
    states = [F.sum(f"state{i}") for i in range(len(SOCKET_STATES))]
    backlog = cells.groupBy("host").agg(F.greatest(*states).alias("most")).where(F.col("most") >= min_count)

    def any_row(found: DataFrame) -> Column:
        return found.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() > 0

    row = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"),
        F.coalesce(F.max("exhausted"), F.lit(False)).alias("thread_exhaustion"),
        F.coalesce(F.max("collected"), F.lit(False)).alias("gc_pressure"),
    ).select(
        "event_count",
        "thread_exhaustion",
        any_row(_growth(buckets.where("current_avg is not null"), window_seconds, growth_ratio)).alias("thread_count_growth"),
        any_row(buckets.where("avg_threads > 0")).alias("latency_vs_thread_load"),
        any_row(backlog).alias("socket_backlog"),
        "gc_pressure",
    )
    signals = sum(
        (F.col(c).cast("int") for c in ("thread_count_growth", "latency_vs_thread_load", "socket_backlog",
                                        "gc_pressure")),
        F.col("thread_exhaustion").cast("int"),
    )
    return row.withColumn("signals", signals).withColumn(
        "confidence",
        F.when(F.col("signals") >= 2, F.lit("High")).when(F.col("signals") == 1, F.lit("Medium")).otherwise(F.lit("Low")),
    )
