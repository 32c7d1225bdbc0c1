"""Detectors of streams with state of their own: the results of the batch detectors, whatever the micro-batches are.

All of them append a result once the watermark has passed everything it depends on, so a result never changes and late
rows within the watermark's delay count. State is kept per time cell or slice, and removed when its timer fires.

Needs the RocksDB state store, which is set where a stream is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.config import DEFAULTS, ERROR_CODE_FIELDS
from eventloom.functions import first_present, floor_div, micros
from eventloom.operators.detectors import TOP_PREFIXES
from eventloom.operators.ordered import US

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60 * US


def _timed(events: DataFrame, late_seconds: int) -> DataFrame:
    events.sparkSession.conf.set(STORE, ROCKSDB)
    return events.withWatermark("time", f"{late_seconds} seconds")


def _before(us: int) -> int:
    """The first millisecond by which all instants before ``us`` have passed."""
    return -(-us // 1000)


# ---------------------------------------------------------------------------
# Spikes
# ---------------------------------------------------------------------------

class SpikeCell(StatefulProcessor):
    """The events of one time cell and of the window behind it, as numbers per instant and host.

    When the watermark has passed them, each minute of the cell is asked for its first event that is followed by enough others.
    """

    def __init__(self, width: int, window: int, threshold: int):
        self.width, self.window, self.threshold = width, window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us bigint, host string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            counted = batch.groupby(["us", "host"], dropna=False).size()
            self.seen.appendList([(int(us), host if isinstance(host, str) else None, int(n)) for (us, host), n in counted.items()])
        self.handle.registerTimer(_before((int(key[0]) + 1) * self.width + self.window))
        yield pd.DataFrame(columns=["us", "event_count", "hosts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.seen.get(), key=lambda r: r[0])
        self.seen.clear()
        at, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 2))
        total = np.append(0, np.cumsum(n))
        last = np.searchsorted(at, at + self.window, side="right")
        found = total[last] - total[np.searchsorted(at, at)]
        anchors = np.flatnonzero((found >= self.threshold) & (at < (int(key[0]) + 1) * self.width))
        _, first = np.unique(at[anchors] // MINUTE, return_index=True)
        out = [(int(at[i]), int(found[i]), sorted({r[1] for r in rows[np.searchsorted(at, at[i]):last[i]]} - {None}))
               for i in anchors[first]]
        yield pd.DataFrame(out, columns=["us", "event_count", "hosts"])


def stream_spikes(events: DataFrame, window_seconds: int = 60, threshold: int = 10,
                  late_seconds: int = DEFAULTS.watch_overlap_seconds) -> DataFrame:
    """What ``detect_spikes`` finds: the first event of each UTC minute that begins a window of ``threshold`` events.

    Cells are whole minutes, at least as long as the window, so a window lies in its cell and the next one.
    """
    window = window_seconds * US
    width = max(1, -(-window // MINUTE)) * MINUTE
    timed = _timed(events, late_seconds)
    host = F.col("host").cast("string") if "host" in events.columns else F.lit("unknown")
    us = micros(F.col("time"))
    cell = floor_div(us, width)
    cells = F.when(F.pmod(us, F.lit(width)) <= window, F.array(cell - 1, cell)).otherwise(F.array(cell))
    found = (
        timed.where(F.col("time").isNotNull()).select(F.explode(cells).alias("cell"), "time", us.alias("us"), host.alias("host"))
        .groupBy("cell")
        .transformWithStateInPandas(SpikeCell(width, window, threshold), "us bigint, event_count bigint, hosts array<string>",
                                    "Append", "EventTime")
    )
    return found.select(F.timestamp_micros("us").alias("window_start"), F.lit(window_seconds).alias("window_seconds"),
                        "event_count", F.lit(threshold).alias("threshold"), "hosts")


# ---------------------------------------------------------------------------
# Cascades
# ---------------------------------------------------------------------------

class OpenSession(StatefulProcessor):
    """The session that may still grow. Cells arrive complete; those of a later batch lie later."""

    COLUMNS = ["first_us", "last_us", "event_count", "hosts", "sourcetypes"]
    SCHEMA = "first_us bigint, last_us bigint, event_count bigint, hosts array<string>, sourcetypes array<string>"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.SCHEMA)

    def _closed(self, sessions: list[list]) -> pd.DataFrame:
        return pd.DataFrame([s for s in sessions if s[2] > 1], columns=self.COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells = pd.concat(list(rows)).sort_values("first_us")
        state = self.open.get() if self.open.exists() else None
        session = [state[0], state[1], state[2], list(state[3]), list(state[4])] if state is not None else None
        closed = []
        for first, last, n, hosts, types in cells[self.COLUMNS].itertuples(index=False):
            if session is not None and first - session[1] <= self.gap:
                session = [session[0], int(last), session[2] + int(n), sorted({*session[3], *hosts}), sorted({*session[4], *types})]
            else:
                closed += [session] if session is not None else []
                session = [int(first), int(last), int(n), sorted(hosts), sorted(types)]
        self.open.update(tuple(session))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a cell that still joins ends within two gaps of the last event
        self.handle.registerTimer(_before(session[1] + 2 * max(self.gap, US)) + 1)
        yield self._closed(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        self.open.clear()
        yield self._closed([list(state)])


def stream_sessions(events: DataFrame, gap_seconds: int = 60, late_seconds: int = DEFAULTS.watch_overlap_seconds) -> DataFrame:
    """What ``correlate_events`` finds, without a key: groups of events each of which follows the one before within the gap.

    First a windowed aggregation turns the events into one row per time cell no wider than the gap, in parallel and with
    partial sums. Only these rows (at most one per gap of time, whatever the number of events) are put in order.
    """
    gap = gap_seconds * US
    timed = _timed(events, late_seconds).where(F.col("time").isNotNull())
    us = micros(F.col("time"))

    def known(name: str):
        return F.col(name).cast("string") if name in events.columns else F.lit("unknown")

    cells = (
        timed.select("time", us.alias("us"), known("host").alias("host"), known("sourcetype").alias("sourcetype"))
        .groupBy(F.window("time", f"{max(gap_seconds, 1)} seconds").alias("w"))
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("event_count"),
             F.collect_set("host").alias("hosts"), F.collect_set("sourcetype").alias("sourcetypes"))
        .select(F.lit(0).alias("axis"), F.window_time("w").alias("time"), *OpenSession.COLUMNS)
    )
    found = cells.groupBy("axis").transformWithStateInPandas(OpenSession(gap), OpenSession.SCHEMA, "Append", "EventTime")
    return found.select(
        F.timestamp_micros("first_us").alias("group_start"), F.timestamp_micros("last_us").alias("group_end"),
        ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("span_seconds"), "event_count",
        F.array_sort("hosts").alias("hosts"), F.array_sort("sourcetypes").alias("sourcetypes"))


# ---------------------------------------------------------------------------
# Repeated line beginnings
# ---------------------------------------------------------------------------

class TopPrefixes(StatefulProcessor):
    """The most frequent line beginnings of a slice seen so far; ``top`` rows of state."""

    def __init__(self, top: int):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "prefixes array<struct<prefix:string,count:bigint>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [(r[0], r[1]) for r in self.best.get()[0]] if self.best.exists() else []
        for batch in rows:
            best += [(p if isinstance(p, str) else None, int(n)) for p, n in zip(batch["prefix"], batch["count"])]
            best = sorted(best, key=lambda r: (-r[1], r[0] is not None, (r[0] or "").encode()))[:self.top]
            end = int(batch["end_us"].iloc[0])
        self.best.update((best,))
        self.handle.registerTimer(_before(end))
        yield pd.DataFrame(columns=["end_us", "prefix", "count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = [(r[0], r[1]) for r in self.best.get()[0]]
        self.best.clear()
        yield pd.DataFrame([(int(key[0]), p, n) for p, n in best], columns=["end_us", "prefix", "count"])


def stream_prefixes(events: DataFrame, slice_seconds: int = 60, late_seconds: int = DEFAULTS.watch_overlap_seconds,
                    length: int = 60, top: int = TOP_PREFIXES) -> DataFrame:
    """What ``detect_raw_prefixes`` finds in each slice of time: its ten most frequent repeated line beginnings.

    Beginnings are counted in parallel; each slice then keeps only its best so far.
    """
    timed = _timed(events, late_seconds).where(F.col("time").isNotNull())
    counted = (
        timed.groupBy(F.window("time", f"{slice_seconds} seconds").alias("w"),
                      F.substring(F.col("_raw").cast("string"), 1, length).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("count")).where("count > 1")
        .select(micros(F.col("w.end")).alias("end_us"), F.window_time("w").alias("time"), "prefix", "count")
    )
    found = counted.groupBy("end_us").transformWithStateInPandas(
        TopPrefixes(top), "end_us bigint, prefix string, count bigint", "Append", "EventTime")
    return found.select(F.timestamp_micros(F.col("end_us") - slice_seconds * US).alias("slice_start"), "prefix", "count")


def stream_patterns(events: DataFrame, slice_seconds: int = 60, late_seconds: int = DEFAULTS.watch_overlap_seconds) -> DataFrame:
    """What ``detect_patterns`` finds in each slice of time: repeated error codes, and repeated line beginnings."""
    code = first_present(events, ERROR_CODE_FIELDS)
    none = F.lit(None).cast("string")
    parts = []
    if code is not None and "sourcetype" in events.columns:
        timed = _timed(events, late_seconds).where(F.col("time").isNotNull())
        parts.append(
            timed.groupBy(F.window("time", f"{slice_seconds} seconds").alias("w"), "sourcetype",
                          F.col(f"`{code}`").cast("string").alias("error_code"))
            .agg(F.count(F.lit(1)).alias("count")).where("count > 1")
            .select(F.col("w.start").alias("slice_start"), F.lit("repeated_error").alias("type"), "sourcetype", "error_code",
                    none.alias("prefix"), "count"))
    if "_raw" in events.columns:
        parts.append(stream_prefixes(events, slice_seconds, late_seconds).select(
            "slice_start", F.lit("repeated_raw_prefix").alias("type"), none.alias("sourcetype"), none.alias("error_code"),
            "prefix", "count"))
    if not parts:
        raise ValueError("patterns need an error code and a sourcetype, or the raw text")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
