"""Investigations that grow: what each detector must keep of the events it has seen, and findings from what was kept.

The state of a step is a few tables, each much narrower than the events: counts per key, first and last sightings per time cell,
the rows that are findings by themselves. States of separate events add up to the state of all of them, so a step reads
the new events once, writes their state as another layer, and takes the findings from all layers. Earlier
events are never read again. Findings equal those of one run over all events.

Layers keep the fields under their own names and types, and are put together by the same rules as events
(``append_events``): where a later step brings a field that takes precedence, earlier rows have no value in it.

| state | a row per | kept |
| --- | --- | --- |
| ``events``, ``words`` | layer | number of events, and of those that name each severity |
| ``levels``, ``repeated``, ``prefixes``, ``hosts`` | level; sourcetype and error code; line beginning; host with errors | number of events |
| ``times`` | instant and host | number of events |
| ``cells`` | time cell, host and sourcetype | first and last instant, number of events |
| ``numbers`` | timed event | order, host and the numeric fields: any later row may change a window of rows |
| ``certs``, ``slow`` | finding | the finding |
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
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
from eventloom.functions import first_present, micros, optional, or_unknown, to_double
from eventloom.operators import detectors as D
from eventloom.operators.normalize import append_events, prepare_events
from eventloom.plans.findings import Findings, text_facts
from eventloom.session import materialize

State = dict[str, DataFrame]


def step_state(events: DataFrame, params: Params = DEFAULTS) -> State:
    """The state of some prepared events, each table written; the raw text is read once."""
    if "_raw" not in events.columns:  # its lines count as empty beside those of other steps
        events = events.withColumn("_raw", F.lit(None).cast("string"))
    if "time" not in events.columns:
        events = events.withColumn("time", F.lit(None).cast("timestamp"))
    facts = materialize(text_facts(events, params), "facts")
    timed = facts.where(F.col("time").isNotNull())
    n = F.count(F.lit(1)).alias("n")
    code, level, host, duration, query = (
        first_present(events, names) for names in (ERROR_CODE_FIELDS, LEVEL_FIELDS, HOST_FIELDS, DURATION_FIELDS, QUERY_FIELDS))

    def own(*names: str | None) -> list:
        return [F.col(f"`{c}`") for c in dict.fromkeys(names) if c in facts.columns]

    named = [F.get("level_words", i) for i in range(len(SEVERITY_LEVELS))]
    is_error = named[SEVERITY_LEVELS.index("ERROR")] | named[SEVERITY_LEVELS.index("CRITICAL")]
    cells = D.session_cells(facts, params.correlate_window_seconds)
    slow = to_double(facts, duration) > params.slow_threshold_ms if duration else F.lit(False)
    tables = {
        "events": facts.agg(n),
        "words": facts.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(test).alias(name) for name, test in zip(SEVERITY_LEVELS, named))),
        "levels": facts.groupBy(*own(level)).agg(n),
        "repeated": facts.groupBy(*own("sourcetype", code)).agg(n),
        "prefixes": facts.groupBy(F.col("line_start").alias("_raw")).agg(n),
        "hosts": facts.where(is_error).groupBy(*own(host)).agg(n),
        "times": timed.groupBy("time", *own("host")).agg(n),
        "cells": cells.drop(*(c for c in ("host", "sourcetype") if c not in facts.columns)),
        "numbers": timed.select("time", "seq", *own(*NUMERIC_FIELDS, *HOST_FIELDS)),
        "certs": facts.where(F.size("cert_words") > 0).select(
            F.lit("cert_anomaly").alias("type"), or_unknown(optional(facts, "host")).alias("host"), "time",
            F.col("cert_words").alias("matched_keywords"), or_unknown(optional(facts, "sourcetype")).alias("sourcetype"),
            F.col("cert_excerpt").alias("raw_excerpt")),
        "slow": facts.where(slow).select(
            "time", *own(duration, *HOST_FIELDS), *([F.col("query").alias(query)] if query else [])),
    }
    return {name: materialize(table, f"state-{name}") for name, table in tables.items()}


def merged(layers: list[State]) -> State:
    return {name: reduce(append_events, (layer[name] for layer in layers)) for name in layers[0]}


def findings_from(state: State, events: DataFrame, params: Params = DEFAULTS) -> Findings:
    """The findings of ``build_findings`` from a merged state. Of ``events`` only the columns are looked at."""
    total = F.sum("n").alias("count")
    code, level, host = (first_present(events, names) for names in (ERROR_CODE_FIELDS, LEVEL_FIELDS, HOST_FIELDS))
    has = set(events.columns)

    def none(schema: str) -> DataFrame:
        return events.sparkSession.createDataFrame([], schema)

    def text(name: str):
        return F.col(f"`{name}`").cast("string")

    repeated = none(D.REPEATED_SCHEMA)
    if code and "sourcetype" in has:
        repeated = state["repeated"].groupBy("sourcetype", text(code).alias("error_code")).agg(total).where("count > 1")
    prefixes = none(D.PREFIX_SCHEMA)
    if "_raw" in has:
        prefixes = (
            state["prefixes"].groupBy(F.col("_raw").alias("prefix")).agg(total).where("count > 1")
            .orderBy(F.desc("count"), F.asc_nulls_first("prefix")).limit(D.TOP_PREFIXES))
    if level:
        severity = state["levels"].groupBy(F.upper(text(level)).alias("level")).agg(total)
    else:
        severity = D.severity_from(state["words"].agg(
            *(F.sum(name).alias(name) for name in ("total", *SEVERITY_LEVELS)))) if "_raw" in has else none(D.SEVERITY_SCHEMA)
    ranking = none(D.RANKING_SCHEMA)
    if host and "_raw" in has:
        ranking = state["hosts"].groupBy(text(host).alias("host")).agg(F.sum("n").alias("error_count")).orderBy(
            F.desc("error_count"), "host")

    def seen(table: DataFrame, *names: str) -> DataFrame:
        for name in names:
            table = table.withColumn(name, text(name) if name in table.columns else F.lit("unknown"))
        return table

    times = seen(state["times"], "host").select(micros(F.col("time")).alias("us"), "host", "n")
    return {
        "spikes": D.spikes_from(times, params.spike_window_seconds, params.spike_threshold),
        "patterns": D.patterns_of(repeated, prefixes),
        "cert_anomalies": state["certs"] if "_raw" in has else none(D.CERT_SCHEMA),
        "correlations": D.sessions_from(seen(state["cells"], "host", "sourcetype"), params.correlate_window_seconds),
        "severity": severity,
        "host_ranking": ranking,
        "slow_queries": D.detect_slow_queries(state["slow"], params.slow_threshold_ms),
        "numeric_anomalies": D.detect_numeric_anomalies(
            state["numbers"], window=params.anomaly_window, z_threshold=params.anomaly_z_threshold),
        "event_count": state["events"].agg(F.sum("n").alias("event_count")),
    }


@dataclass(frozen=True)
class Investigation:
    """Events seen so far, as the states of their steps; ``columns`` is an empty frame with the fields of all events."""

    columns: DataFrame
    layers: tuple[State, ...]
    params: Params = DEFAULTS

    def findings(self) -> Findings:
        return findings_from(merged(list(self.layers)), self.columns, self.params)

    def grow(self, more: DataFrame | None) -> tuple[str, Investigation, Findings | None]:
        """Add follow-up events and look again; ``done`` when there are none."""
        if more is None or more.isEmpty():
            return "done", self, None
        more = prepare_events(more)
        grown = replace(self, columns=append_events(self.columns, _without_rows(more)),
                        layers=(*self.layers, step_state(more, self.params)))
        return "continue", grown, grown.findings()


def investigate(events: DataFrame, params: Params = DEFAULTS) -> Investigation:
    """Begin with prepared events."""
    return Investigation(_without_rows(events), (step_state(events, params),), params)


def _without_rows(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([], events.schema)
