"""Follow-up aggregations an analyst runs next, by area name.

All take the same arguments; empty hosts or error codes and sourcetype ``*`` mean no restriction.
Time ranges are half open.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import ERROR_CODE_FIELDS
from eventloom.functions import first_present, optional, row_order, to_bigint, to_double
from eventloom.operators.transaction import transaction

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class FollowUp:
    """What the findings point at: hosts, codes, sourcetype and the first burst."""

    hosts: Sequence[str] = ()
    error_codes: Sequence[str] = ()
    sourcetype: str = "*"
    spike_start: datetime | None = None


def error_filter(events: DataFrame, error_codes: Sequence[str]) -> Column:
    codes = [c.strip() for c in error_codes if c.strip()]
    field = first_present(events, ERROR_CODE_FIELDS)
    if not codes:
        return F.lit(True)
    return F.col(field).isin(codes) if field else F.lit(False)


def _select(events: DataFrame, ask: FollowUp, sourcetype: bool = True, hosts: bool = True,
            before: timedelta | None = None, after: timedelta | None = None) -> DataFrame:
    """Restrict events; every condition is on a plain column, so it reaches the scan."""
    names = [h.strip() for h in ask.hosts if h.strip()]
    if hosts and names:
        events = events.where(F.col("host").isin(names))
    if sourcetype and ask.sourcetype.strip() not in ("", "*"):
        events = events.where(F.col("sourcetype") == ask.sourcetype.strip())
    if after is not None and ask.spike_start is not None:
        spike = ask.spike_start
        spike = spike if spike.tzinfo else spike.replace(tzinfo=timezone.utc)
        begin, end = spike - (before or timedelta(0)), spike + after
        events = events.where((F.col("time") >= F.lit(begin)) & (F.col("time") < F.lit(end)))
    return events


def area_api_errors(events: DataFrame, ask: FollowUp) -> DataFrame:
    """Failed requests by host, status and uri in the hour after the spike began."""
    if "status" not in events.columns:
        return events.sparkSession.createDataFrame([], "host string, status bigint, uri string, count bigint")
    chosen = _select(events, ask, after=timedelta(hours=1))
    return (
        chosen.select(optional(events, "host").alias("host"), to_bigint(events, "status").alias("status"),
                      optional(events, "uri").alias("uri"))
        .where(F.col("status") >= 400)
        .groupBy("host", "status", "uri")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "host", "status", "uri")
    )


def area_database_slowdown(events: DataFrame, ask: FollowUp, threshold_ms: float = 1000) -> DataFrame:
    """Slow events per host in the hour after the spike began."""
    if "duration_ms" not in events.columns:
        return events.sparkSession.createDataFrame([], "host string, avg_ms double, max_ms double, count bigint")
    chosen = _select(events, ask, after=timedelta(hours=1))
    return (
        chosen.select(optional(events, "host").alias("host"), to_double(events, "duration_ms").alias("ms"))
        .where(F.col("ms") > threshold_ms)
        .groupBy("host")
        .agg(F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("max_ms"), "host")
    )


def area_cascading_failure(events: DataFrame, ask: FollowUp) -> DataFrame:
    """Host transactions of at most an hour, from 5 minutes before to 30 minutes after the spike began."""
    chosen = _select(events, ask, sourcetype=False, before=timedelta(minutes=5), after=timedelta(minutes=30))
    return transaction(chosen, "host", 3600).select(
        F.col("start_time").alias("time"), "host", "duration", F.col("event_count").alias("eventcount")
    )


def area_host_isolation(events: DataFrame, ask: FollowUp) -> DataFrame:
    """Events by host, sourcetype and error code in the two hours after the spike began."""
    code = optional(events, first_present(events, ERROR_CODE_FIELDS)).cast("string").alias("error_code")
    return (
        _select(events, ask, sourcetype=False, after=timedelta(hours=2))
        .groupBy("host", "sourcetype", code)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "host", "sourcetype", "error_code")
    )


def area_timeline(events: DataFrame, ask: FollowUp) -> DataFrame:
    """Matching events per minute and host."""
    return (
        _select(events, ask, hosts=False)
        .where(error_filter(events, ask.error_codes) & F.col("time").isNotNull())
        .groupBy(F.date_trunc("minute", "time").alias("minute"), "host")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("minute", "host")
    )


def timeline_chart(events: DataFrame, ask: FollowUp, filled: bool = False) -> DataFrame:
    """The timeline with one column per asked host (an explicit list, so one aggregation).

    ``filled`` adds the minutes without events between the first and the last, with zeros.
    """
    chart = (
        _select(events, ask, hosts=False)
        .where(error_filter(events, ask.error_codes) & F.col("time").isNotNull())
        .groupBy(F.date_trunc("minute", "time").alias("minute"))
        .agg(*[F.count_if(F.col("host") == h).alias(h) for h in ask.hosts])
    )
    if filled:
        ends = chart.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).where(F.col("a").isNotNull())
        minutes = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))
        chart = minutes.join(chart, "minute", "left").fillna(0)
    return chart.orderBy("minute")


def area_first_occurrence(events: DataFrame, ask: FollowUp) -> DataFrame:
    """The earliest matching event; a top-1 per partition, not a sort."""
    return (
        _select(events, ask, hosts=False)
        .where(error_filter(events, ask.error_codes) & F.col("time").isNotNull())
        .withColumn("__seq", row_order(events))
        .orderBy("time", "__seq")
        .limit(1)
        .select("time", "host", "sourcetype", optional(events, "message").alias("message"))
    )


AREAS: dict[str, Callable[[DataFrame, FollowUp], DataFrame]] = {
    "api_errors": area_api_errors,
    "database_slowdown": area_database_slowdown,
    "cascading_failure": area_cascading_failure,
    "host_isolation": area_host_isolation,
    "timeline": area_timeline,
    "first_occurrence": area_first_occurrence,
}


def area_dispatch(events: DataFrame, areas: Sequence[str], ask: FollowUp) -> dict[str, DataFrame]:
    """One frame per known area; unknown names are skipped with a warning."""
    chosen = {}
    for name in (a.strip() for a in areas):
        if not name:
            continue
        if name in AREAS:
            chosen[name] = AREAS[name](events, ask)
        else:
            logger.warning("unknown area %r skipped", name)
    return chosen
