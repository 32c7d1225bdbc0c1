"""Continuous alerting: tagged alerts, stateful stream forms of the detectors, and the watch loop."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import DEFAULTS, ERROR_CODE_FIELDS, Params
from eventloom.functions import first_present, optional, relative_time
from eventloom.functions.text import iso_text
from eventloom.operators import detectors as D
from eventloom.session import materialize, remove_path, scratch_scope
from eventloom.sources.tables import alert_rows, path_part, store_alerts

logger = logging.getLogger(__name__)

MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


# ---------------------------------------------------------------------------
# Tagging
# ---------------------------------------------------------------------------

def _tag(found: DataFrame, detector: str, severity: Column, summary: Column) -> DataFrame:
    """Alerts of findings; ``row_id`` is that of the event, where a finding is one."""
    return found.select(
        F.lit(detector).alias("detector"),
        severity.alias("severity"),
        summary.alias("summary"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns if c != "row_id"])).alias("detail_json"),
        optional(found, "row_id").alias("row_id"),
    )


def tag_slow(found: DataFrame, threshold_ms: float) -> DataFrame:
    return _tag(
        found, "slow_query",
        F.when(F.col("duration_ms") >= threshold_ms * 3, F.lit("critical")).otherwise(F.lit("warning")),
        F.concat(F.lit("Slow query: "), F.rint("duration_ms").cast("bigint").cast("string"), F.lit("ms on "),
                 F.coalesce("host", F.lit("unknown"))),
    )


def tag_spikes(found: DataFrame) -> DataFrame:
    return _tag(
        found, "spike", F.lit("warning"),
        F.concat(F.lit("Spike: "), F.col("event_count").cast("string"), F.lit(" events in "),
                 F.col("window_seconds").cast("string"), F.lit("s starting "), iso_text(F.col("window_start"))),
    )


def tag_patterns(found: DataFrame) -> DataFrame:
    return _tag(
        found, "pattern", F.lit("info"),
        F.concat(F.lit("Repeated "), "type", F.lit(": count="), F.col("count").cast("string")),
    )


def tag_certs(found: DataFrame) -> DataFrame:
    return _tag(
        found, "cert_anomaly", F.lit("warning"),
        F.concat(F.lit("Cert anomaly on "), "host", F.lit(": "), F.array_join("matched_keywords", ", ")),
    )


def tag_http(found: DataFrame) -> DataFrame:
    return _tag(
        found, "http_error",
        F.when(F.col("class") == "5xx", F.lit("critical")).otherwise(F.lit("warning")),
        F.concat(F.lit("HTTP "), F.col("status_code").cast("string"), F.lit(" on "),
                 F.coalesce("host", F.lit("unknown")),
                 F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit(" "), "path")).otherwise(F.lit(""))),
    )


def alert_detectors(params: Params = DEFAULTS) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The detectors of the watch loop, each giving tagged alerts."""
    return {
        "slow_query": lambda e: tag_slow(D.slow_rows(e, params.slow_threshold_ms, True), params.slow_threshold_ms),
        "spike": lambda e: tag_spikes(D.detect_spikes(e, params.spike_window_seconds, params.spike_threshold)),
        "pattern": lambda e: tag_patterns(D.detect_patterns(e)),
        "cert_anomaly": lambda e: tag_certs(D.detect_cert_anomalies(e, params.cert_keywords, True)),
        "http_error": lambda e: tag_http(D.http_rows(e, True)),
    }


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def tag_alerts(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All alerts of a batch: ``detector, severity, summary, detail_json, row_id``."""
    return _union([detect(events) for detect in alert_detectors(params).values()])


# ---------------------------------------------------------------------------
# Stream forms
# ---------------------------------------------------------------------------

def stream_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  started: datetime | None = None, lookback: str = DEFAULTS.watch_lookback,
                  time_column: str = "time", **options) -> DataFrame:
    """Events as they arrive. The checkpoint keeps the position; only the first start needs the
    ``lookback``, relative to ``started``."""
    events = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    if started is not None:
        events = events.where(F.col(time_column) >= F.lit(relative_time(lookback, started)))
    return events


def without_repeats(events: DataFrame, keys: list[str], overlap_seconds: int = DEFAULTS.watch_overlap_seconds
                    ) -> DataFrame:
    """Drop events read again because poll ranges overlap; state is kept for the overlap only."""
    return events.withWatermark("time", f"{overlap_seconds} seconds").dropDuplicatesWithinWatermark(keys)


def stream_row_alerts(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Alerts that a single event decides: slow, certificate, HTTP. Stateless."""
    rows = alert_detectors(params)
    return _union([rows[name](events) for name in ("slow_query", "cert_anomaly", "http_error")])


def stream_spikes(events: DataFrame, window_seconds: int = 60, threshold: int = 10, slide_seconds: int | None = None,
                  late_seconds: int = DEFAULTS.watch_overlap_seconds) -> DataFrame:
    """Windows on a fixed grid with at least ``threshold`` events.

    Grid windows are half open and begin on the grid, so this approximates the event-anchored
    batch detector; the watch loop below runs the exact one on every slice.
    """
    slide = slide_seconds or window_seconds
    return (
        events.withWatermark("time", f"{late_seconds} seconds")
        .groupBy(F.window("time", f"{window_seconds} seconds", f"{slide} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_set("host")).alias("hosts"))
        .where(F.col("event_count") >= threshold)
        .select(F.col("w.start").alias("window_start"), F.lit(window_seconds).alias("window_seconds"),
                "event_count", F.lit(threshold).alias("threshold"), "hosts")
    )


def stream_patterns(events: DataFrame, window_seconds: int = 60, late_seconds: int = DEFAULTS.watch_overlap_seconds
                    ) -> DataFrame:
    """Repeated (sourcetype, error code) per time slice."""
    code = first_present(events, ERROR_CODE_FIELDS)
    return (
        events.withWatermark("time", f"{late_seconds} seconds")
        .groupBy(F.window("time", f"{window_seconds} seconds").alias("w"), "sourcetype",
                 F.col(code).cast("string").alias("error_code"))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .select(F.col("w.start").alias("slice_start"), "sourcetype", "error_code", "count")
    )


def stream_sessions(events: DataFrame, key: str = "app", gap_seconds: int = 60,
                    late_seconds: int = DEFAULTS.watch_overlap_seconds) -> DataFrame:
    """Cascades per ``key`` (a stream cannot hold one global session without a key).

    Each task merges the sessions of its own events before the shuffle, so the one task that a key meets in gets a row per
    task and session, not one per event.
    """
    events.sparkSession.conf.set(MERGE_SESSIONS, "true")
    return (
        events.withWatermark("time", f"{late_seconds} seconds")
        .groupBy(F.session_window("time", f"{gap_seconds} seconds").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("event_count"), F.min("time").alias("group_start"),
             F.max("time").alias("group_end"), F.array_sort(F.collect_set("host")).alias("hosts"),
             F.array_sort(F.collect_set("sourcetype")).alias("sourcetypes"))
        .where(F.col("event_count") > 1)
        .select(key, "group_start", "group_end", "event_count", "hosts", "sourcetypes")
    )


# ---------------------------------------------------------------------------
# Watch loop
# ---------------------------------------------------------------------------

def watch_cycle(batch: DataFrame, batch_id: int, root: str, run_id: str, params: Params = DEFAULTS,
                arrived: datetime | None = None) -> None:
    """One cycle: run the exact batch detectors on the new events plus the overlap, store new alerts.

    Per cycle three small tables are written below ``root``: the events of the overlap (``tail``),
    the ids of all hits of the slice (``ids``), and the alerts. A hit seen again because of the
    overlap has the id it had in the cycle before and is not raised twice. Everything a cycle
    writes is named by its batch id and overwritten, so a repeated batch changes nothing.

    The overlap ends at the newest event that a clock can have written by the time the cycle ``arrived`` (now, unless given),
    give or take the overlap. Events of a later time are analysed in their cycle, but neither kept for the next one nor allowed
    to end the overlap of the others; events that come late are kept as long as they lie within the overlap.

    A detector that fails is logged and skipped; a failing write stops the query, which then
    resumes from its checkpoint. Intermediate tables and those of the cycle before last are removed.
    """
    with scratch_scope(batch.sparkSession):
        _run_cycle(batch, batch_id, root, run_id, params, arrived or datetime.now(timezone.utc))
    if batch_id > 1:
        remove_path(batch.sparkSession, f"{_state(root, run_id)}/{batch_id - 2}")


def _state(root: str, run_id: str) -> str:
    """Where a run keeps what its next cycle needs; runs on one root do not meet."""
    return f"{root}/watch/{path_part(run_id)}"


def _planned(detect: Callable[[DataFrame], DataFrame], events: DataFrame, run_id: str) -> DataFrame | None:
    """The plan of a detector's alerts, or nothing if the detector itself is broken.

    Only errors of plan building are the detector's own. What Spark or storage report, also from the small jobs
    that some detectors run at once, goes on and stops the query, so that the batch is repeated.
    """
    try:
        return alert_rows(detect(events), run_id)
    except (OSError, Py4JError):
        raise
    except Exception as error:
        if isinstance(error, PySparkException) and not isinstance(error, AnalysisException):
            raise
        logger.exception("detector %s failed", getattr(detect, "__name__", detect))
        return None


def _run_cycle(batch: DataFrame, batch_id: int, root: str, run_id: str, params: Params, arrived: datetime) -> None:
    spark = batch.sparkSession
    here, before = f"{_state(root, run_id)}/{batch_id}", f"{_state(root, run_id)}/{batch_id - 1}"
    events = batch
    if batch_id > 0:
        events = spark.read.schema(batch.schema).parquet(f"{before}/tail").unionByName(batch)
    # read by every detector and by the next cycle; in even parts, however few files or row groups the batch came in
    events = materialize(events.hint("rebalance"), "slice")

    hits = []
    for name, detect in alert_detectors(params).items():
        plan = _planned(detect, events, run_id)
        if plan is not None:
            hits.append(materialize(plan, f"hits-{name}"))
    # a burst across the edge of two cycles is seen whole only if a whole window is kept
    overlap = max(params.watch_overlap_seconds, params.spike_window_seconds)
    possible = events.where(F.col("time") <= F.lit(arrived + timedelta(seconds=overlap)))
    kept_from = possible.agg(F.max("time")).scalar() - F.expr(f"interval {overlap} seconds")
    possible.where(F.col("time") >= kept_from).write.mode("overwrite").parquet(f"{here}/tail")

    found = _union(hits) if hits else alert_rows(
        spark.createDataFrame([], "detector string, severity string, summary string, detail_json string, row_id string"), run_id)
    found.select("alert_id").distinct().write.mode("overwrite").parquet(f"{here}/ids")
    fresh = found.dropDuplicates(["alert_id"])
    if batch_id > 0:
        known = spark.read.schema("alert_id string").parquet(f"{before}/ids")
        fresh = fresh.join(known, "alert_id", "left_anti")
    store_alerts(fresh, root, run_id, str(batch_id))


def start_watch(events: DataFrame, root: str, run_id: str, params: Params = DEFAULTS, once: bool = False
                ) -> StreamingQuery:
    """Run the watch loop on a stream; ``once`` processes what is there and stops."""
    writer = events.writeStream.foreachBatch(
        lambda batch, batch_id: watch_cycle(batch, batch_id, root, run_id, params)
    ).option("checkpointLocation", f"{root}/checkpoints/{run_id}")
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{params.watch_interval_seconds} seconds").start()


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Drain a stream into a Parquet table: appended by the file sink, or rewritten as a whole when
    an aggregation is kept complete."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda result, _: result.write.mode("overwrite").parquet(path)
        )
    return writer.option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()
