"""Core detectors. Each takes an event frame and returns a typed frame of findings.

Columns are resolved from the schema first; when a required one is absent the result is an
empty frame of the same type, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.config import (
    CERT_KEYWORDS,
    DURATION_FIELDS,
    ERROR_CODE_FIELDS,
    HOST_FIELDS,
    LEVEL_FIELDS,
    NUMERIC_FIELDS,
    PAIR_PATTERNS,
    PATH_FIELDS,
    QUERY_FIELDS,
    SEVERITY_LEVELS,
    STATUS_FIELDS,
    PairPattern,
)
from eventloom.functions import (
    contains_any,
    error_line,
    first_present,
    floor_div,
    matched_keywords,
    micros,
    non_blank,
    optional,
    or_unknown,
    row_order,
    to_bigint,
    to_double,
)
from eventloom.functions.columns import host_column
from eventloom.operators.ordered import (
    US,
    forward_counts,
    gap_sessions,
    group_numbers,
    near_bursts,
    number_rows,
    with_halo,
)
from eventloom.session import materialize

SPIKE_SCHEMA = "window_start timestamp, window_seconds int, event_count bigint, threshold int, hosts array<string>"
REPEATED_SCHEMA = "sourcetype string, error_code string, count bigint"
PREFIX_SCHEMA = "prefix string, count bigint"
SESSION_SCHEMA = (
    "group_start timestamp, group_end timestamp, span_seconds double, event_count bigint, "
    "hosts array<string>, sourcetypes array<string>"
)
PAIR_SCHEMA = (
    "entity_field string, entity string, first_pattern string, second_pattern string, first_time timestamp, "
    "second_time timestamp, span_seconds double, first_raw_excerpt string, second_raw_excerpt string"
)
CERT_SCHEMA = (
    "type string, host string, time timestamp, matched_keywords array<string>, sourcetype string, "
    "raw_excerpt string"
)
SEVERITY_SCHEMA = "level string, count bigint"
RANKING_SCHEMA = "host string, error_count bigint"
SLOW_SCHEMA = "duration_ms double, field string, host string, query string, time timestamp"
HTTP_SCHEMA = "status_code bigint, class string, field string, host string, path string, time timestamp"
ANOMALY_SCHEMA = (
    "field string, value double, z_score double, rolling_mean double, rolling_std double, time timestamp, "
    "window_contaminated boolean, host string"
)


def _empty(events: DataFrame, schema: str) -> DataFrame:
    return events.sparkSession.createDataFrame([], schema)


def _timed(events: DataFrame) -> DataFrame:
    return events.where(F.col("time").isNotNull())


# ---------------------------------------------------------------------------
# Spikes
# ---------------------------------------------------------------------------

def detect_spikes(events: DataFrame, window_seconds: int = 60, threshold: int = 10) -> DataFrame:
    """Bursts: the first event of each UTC minute that is followed by ``threshold`` events in time.

    The window is closed and begins at the event, which counts itself.
    """
    if "time" not in events.columns:
        return _empty(events, SPIKE_SCHEMA)
    host = F.col("host").cast("string") if "host" in events.columns else F.lit("unknown")
    timed = _timed(events).select(micros(F.col("time")).alias("us"), host.alias("host"), F.lit(1).cast("bigint").alias("n"))
    return spikes_from(timed, window_seconds, threshold)


def spikes_from(timed: DataFrame, window_seconds: int, threshold: int) -> DataFrame:
    """Spikes of rows ``us, host, n``, each of which stands for ``n`` events."""
    timed = near_bursts(timed, window_seconds, threshold)
    times = timed.groupBy("us").agg(F.sum("n").alias("n"))
    anchors = (
        forward_counts(times, window_seconds, threshold)
        .groupBy(floor_div(F.col("us"), 60 * US).alias("minute"))
        .agg(F.min("us").alias("us"), F.min_by("event_count", "us").alias("event_count"))
        .drop("minute")
    )
    return (
        _with_window_hosts(timed, anchors, window_seconds * US)
        .select(
            F.timestamp_micros("us").alias("window_start"),
            F.lit(window_seconds).alias("window_seconds"),
            "event_count",
            F.lit(threshold).alias("threshold"),
            "hosts",
        )
        .orderBy("window_start")
    )


def _with_window_hosts(timed: DataFrame, anchors: DataFrame, span_us: int) -> DataFrame:
    """Add the hosts seen within ``span_us`` after each anchor.

    On cells as wide as the window, a window covers the end of one cell and the start of the
    next. So first and last sighting of a host per cell decide, and events never meet anchors.
    """
    width = max(span_us, 1)
    sightings = (
        timed.where(F.col("host").isNotNull())
        .groupBy(floor_div(F.col("us"), width).alias("cell"), "host")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )
    cell = floor_div(F.col("us"), width)
    visits = anchors.withColumn(
        "visit",
        F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("opening")),
                          F.struct((cell + 1).alias("cell"), F.lit(False).alias("opening")))),
    ).select(*anchors.columns, "visit.cell", "visit.opening")
    seen = F.when(F.col("opening"), F.col("last_us") >= F.col("us")).otherwise(
        F.col("first_us") <= F.col("us") + span_us
    )
    return (
        visits.join(sightings, "cell", "left")
        .groupBy(*anchors.columns)
        .agg(F.array_sort(F.collect_set(F.when(seen, F.col("host")))).alias("hosts"))
    )


# ---------------------------------------------------------------------------
# Repeated patterns
# ---------------------------------------------------------------------------

def detect_repeated_errors(events: DataFrame) -> DataFrame:
    """(sourcetype, error code) combinations that occur more than once."""
    code = first_present(events, ERROR_CODE_FIELDS)
    if code is None or "sourcetype" not in events.columns:
        return _empty(events, REPEATED_SCHEMA)
    return (
        events.groupBy("sourcetype", F.col(code).cast("string").alias("error_code"))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .orderBy(F.desc("count"), "sourcetype", "error_code")
    )


TOP_PREFIXES = 10


def detect_raw_prefixes(events: DataFrame, length: int = 60, top: int = TOP_PREFIXES) -> DataFrame:
    """The ten most frequent repeated line beginnings."""
    if "_raw" not in events.columns:
        return _empty(events, PREFIX_SCHEMA)
    return (
        events.groupBy(F.substring(F.col("_raw").cast("string"), 1, length).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .orderBy(F.desc("count"), F.asc_nulls_first("prefix"))
        .limit(top)
    )


def detect_patterns(events: DataFrame) -> DataFrame:
    return patterns_of(detect_repeated_errors(events), detect_raw_prefixes(events))


def patterns_of(repeated: DataFrame, prefixes: DataFrame) -> DataFrame:
    repeated = repeated.select(
        F.lit("repeated_error").alias("type"), "sourcetype", "error_code",
        F.lit(None).cast("string").alias("prefix"), "count",
    )
    prefixes = prefixes.select(
        F.lit("repeated_raw_prefix").alias("type"), F.lit(None).cast("string").alias("sourcetype"),
        F.lit(None).cast("string").alias("error_code"), "prefix", "count",
    )
    return repeated.unionByName(prefixes)


# ---------------------------------------------------------------------------
# Cascades
# ---------------------------------------------------------------------------

def correlate_events(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Groups of two or more events in which each follows the one before within the window.

    Global, not per host. Events first collapse to one row per (time cell, host, sourcetype).
    """
    if "time" not in events.columns:
        return _empty(events, SESSION_SCHEMA)
    # used by the axis, its prefix and the join back: written once instead of read from the events each time
    return sessions_from(materialize(session_cells(events, window_seconds), "session-cells"), window_seconds)


def session_cells(events: DataFrame, window_seconds: int) -> DataFrame:
    """``cell, host, sourcetype, first_us, last_us, n`` of the timed events; tables of cells add up to those of all events."""
    return (
        _timed(events)
        .select(
            micros(F.col("time")).alias("us"),
            *[
                (F.col(c).cast("string") if c in events.columns else F.lit("unknown")).alias(c)
                for c in ("host", "sourcetype")
            ],
        )
        .groupBy(floor_div(F.col("us"), max(window_seconds * US, 1)).alias("cell"), "host", "sourcetype")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    )


def sessions_from(cells: DataFrame, window_seconds: int) -> DataFrame:
    """Cascades of written cells, of which several may be of one time cell, host and sourcetype."""
    gap_us = window_seconds * US
    axis = cells.groupBy("cell").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    numbered = gap_sessions(axis, gap_us).select("cell", "session")
    groups = (
        cells.join(numbered, "cell")
        # a session may span the whole input: reduced to its distinct sources before anything is collected
        .groupBy("session", "host", "sourcetype")
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"))
        .groupBy("session")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("n").alias("event_count"),
            F.array_sort(F.collect_set("host")).alias("hosts"),
            F.array_sort(F.collect_set("sourcetype")).alias("sourcetypes"),
        )
        .where(F.col("event_count") > 1)
    )
    return (
        groups.select(
            F.timestamp_micros("first_us").alias("group_start"),
            F.timestamp_micros("last_us").alias("group_end"),
            ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("span_seconds"),
            "event_count",
            "hosts",
            "sourcetypes",
        )
        .orderBy("group_start")
    )


# ---------------------------------------------------------------------------
# Event pairs
# ---------------------------------------------------------------------------

def detect_event_pairs(events: DataFrame, entity_field: str, first_pattern: str, second_pattern: str,
                       maxspan_seconds: int = 3600) -> DataFrame:
    """Per entity: its earliest line with the first pattern, and the earliest later line with the
    second pattern within the span. At most one pair per entity; no re-arming."""
    return detect_event_pair_patterns(
        events, [PairPattern(entity_field, first_pattern, second_pattern, maxspan_seconds)]
    )


def detect_event_pair_patterns(events: DataFrame, patterns: Sequence[PairPattern] | None = None) -> DataFrame:
    """All pair rules in one pass: two aggregations around one join on (rule, entity)."""
    wanted = usable_pairs(events, patterns)
    if not wanted:
        return _empty(events, PAIR_SCHEMA)
    # Both sides below are made of these few rows, so the raw text is read and searched only once.
    text = F.lower(F.col("_raw").cast("string"))
    hits = (
        _timed(events)
        .where(contains_any(text, [w.lower() for _, p in wanted for w in (p.first_pattern, p.second_pattern)]))
        .select(F.explode(pair_hits(events, wanted)).alias("hit"), pair_line(events).alias("line"))
        .select("hit.*", "line")
    )
    return pairs_from_hits(materialize(hits, "pair-hits"), wanted)


def usable_pairs(events: DataFrame, patterns: Sequence[PairPattern] | None) -> list[tuple[int, PairPattern]]:
    """Numbered rules whose entity field the frame has."""
    if not {"time", "_raw"} <= set(events.columns):
        return []
    return [(i, p) for i, p in enumerate(patterns or PAIR_PATTERNS) if p.entity_field in events.columns]


def pair_hits(events: DataFrame, wanted: Sequence[tuple[int, PairPattern]]) -> Column:
    """What a line means to the rules: ``rule, opens, entity`` per first or second pattern it holds."""
    text = F.lower(F.coalesce(F.col("_raw").cast("string"), F.lit("")))
    return F.array_compact(F.array(*[
        F.when(
            F.contains(text, F.lit(pattern.lower())),
            F.struct(F.lit(i).alias("rule"), F.lit(opens).alias("opens"),
                     F.col(f"`{p.entity_field}`").cast("string").alias("entity")),
        )
        for i, p in wanted
        for pattern, opens in ((p.first_pattern, True), (p.second_pattern, False))
    ]))


def pair_line(events: DataFrame) -> Column:
    return F.struct(
        micros(F.col("time")).alias("us"),
        row_order(events).alias("seq"),
        F.substring(F.coalesce(F.col("_raw").cast("string"), F.lit("")), 1, 120).alias("excerpt"),
    )


def pairs_from_hits(hits: DataFrame, wanted: Sequence[tuple[int, PairPattern]]) -> DataFrame:
    """Pairs from a table of hits (``rule, opens, entity, line``)."""

    def of_rule(value, rule: str = "rule"):
        """Per-rule constant, looked up by rule number."""
        table = F.create_map(*[x for i, p in wanted for x in (F.lit(i), F.lit(value(p)))])
        return F.element_at(table, F.col(rule))

    # A second line lies in the cell of its first line or in the next one when cells are just wider
    # than the span. With the cell in the key, the lines of a hot entity spread over many tasks, and
    # all but two cells per entity find no partner.
    def cell(us: str):
        return floor_div(F.col(us), of_rule(lambda p: p.maxspan_seconds * US + 1))

    first = (
        hits.where("opens").groupBy("rule", "entity").agg(F.min("line").alias("first"))
        .withColumn("cell", F.explode(F.array(cell("first.us"), cell("first.us") + 1)))
    )
    later = (
        hits.where("not opens").withColumn("cell", cell("line.us")).alias("b")
        .join(
            first.alias("a"),
            (F.col("a.rule") == F.col("b.rule"))
            & F.col("a.entity").eqNullSafe(F.col("b.entity"))
            & (F.col("a.cell") == F.col("b.cell"))
            & (F.struct("b.line.us", "b.line.seq") > F.struct("a.first.us", "a.first.seq"))
            & (F.col("b.line.us") - F.col("a.first.us") <= of_rule(lambda p: p.maxspan_seconds * US, "a.rule")),
        )
        .select("a.rule", "a.entity", "a.first", "b.line")
    )
    pairs = later.groupBy("rule", "entity").agg(F.min("first").alias("first"), F.min("line").alias("second"))

    return (
        pairs.select(
            of_rule(lambda p: p.entity_field).alias("entity_field"),
            "entity",
            of_rule(lambda p: p.first_pattern).alias("first_pattern"),
            of_rule(lambda p: p.second_pattern).alias("second_pattern"),
            F.timestamp_micros("first.us").alias("first_time"),
            F.timestamp_micros("second.us").alias("second_time"),
            ((F.col("second.us") - F.col("first.us")) / F.lit(1e6)).alias("span_seconds"),
            F.col("first.excerpt").alias("first_raw_excerpt"),
            F.col("second.excerpt").alias("second_raw_excerpt"),
        )
        .orderBy("first_time", "entity_field", "entity", "first_pattern", "second_pattern")
    )


# ---------------------------------------------------------------------------
# Keyword scans
# ---------------------------------------------------------------------------

def _haystack(events: DataFrame, also: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("_raw", *also) if c in events.columns]
    return F.lower(F.concat_ws(" ", *parts))


def _row_id(events: DataFrame, wanted: bool) -> list[Column]:
    """What tells equal findings of different events apart: ``seq``, or a digest of the row."""
    return [row_order(events).cast("string").alias("row_id")] if wanted else []


def keyword_scan(events: DataFrame, kind: str, keywords: Sequence[str], excerpt: int,
                 also: Sequence[str] = (), row_id: bool = False) -> DataFrame:
    """Lines whose text (with the optional further fields) holds any keyword; map-only."""
    words = [k.lower() for k in keywords]
    text = _haystack(events, also)
    return events.where(contains_any(text, words)).select(
        F.lit(kind).alias("type"),
        or_unknown(optional(events, "host")).alias("host"),
        optional(events, "time", "timestamp").alias("time"),
        matched_keywords(text, words).alias("matched_keywords"),
        or_unknown(optional(events, "sourcetype")).alias("sourcetype"),
        F.substring(F.coalesce(F.col("_raw").cast("string"), F.lit("")), 1, excerpt).alias("raw_excerpt"),
        *_row_id(events, row_id),
    )


CERT_TEXT = ("tls_error", "ocsp_status")


def cert_keywords_in(events: DataFrame, keywords: Sequence[str] | None = None) -> Column:
    return matched_keywords(_haystack(events, CERT_TEXT), [k.lower() for k in keywords or CERT_KEYWORDS])


def detect_cert_anomalies(events: DataFrame, keywords: Sequence[str] | None = None, row_id: bool = False) -> DataFrame:
    if "_raw" not in events.columns:
        return _empty(events, CERT_SCHEMA)
    return keyword_scan(events, "cert_anomaly", keywords or CERT_KEYWORDS, 120, CERT_TEXT, row_id)


# ---------------------------------------------------------------------------
# Severity and hosts
# ---------------------------------------------------------------------------

def level_tests(raw: Column) -> list[Column]:
    """One test per severity level: whether its word occurs in the text."""
    text = F.upper(raw.cast("string"))
    return [F.contains(text, F.lit(name)) for name in SEVERITY_LEVELS]


def severity_summary(events: DataFrame, tests: Sequence[Column] | None = None, exclusive: bool = False) -> DataFrame:
    """Events per level. Without a level column the level words are counted in the raw text.

    The counted words are not exclusive: a WARNING line is also a WARN line, and UNKNOWN is the
    number of events minus all counts, so it can be negative. With ``exclusive`` a line counts once, under the first
    level in the order of ``SEVERITY_LEVELS`` that it names, WARNING before WARN. ``tests`` replace the search of the
    text where it was done before.
    """
    level = first_present(events, LEVEL_FIELDS)
    if level is not None:
        return events.groupBy(F.upper(F.col(level).cast("string")).alias("level")).agg(
            F.count(F.lit(1)).alias("count")
        )
    if tests is None and "_raw" not in events.columns:
        return _empty(events, SEVERITY_SCHEMA)
    named = dict(zip(SEVERITY_LEVELS, tests or level_tests(F.col("_raw"))))
    if exclusive:
        # the longer word first: each WARNING line also holds WARN
        order = sorted(named, key=lambda name: (SEVERITY_LEVELS.index(name.removesuffix("ING")), -len(name)))
        first = F.coalesce(*(F.when(named[name], F.lit(name)) for name in order))
        named = {name: first == name for name in SEVERITY_LEVELS}
    return severity_from(
        events.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(test).alias(name) for name, test in named.items()]))


def severity_from(totals: DataFrame) -> DataFrame:
    """Levels from one row with the ``total`` and the count of each level."""
    unknown = F.col("total") - sum((F.col(name) for name in SEVERITY_LEVELS[1:]), F.col(SEVERITY_LEVELS[0]))
    pairs = [F.struct(F.lit(name).alias("level"), F.col(name).alias("count")) for name in SEVERITY_LEVELS]
    pairs.append(F.struct(F.lit("UNKNOWN").alias("level"), unknown.alias("count")))
    return totals.select(F.explode(F.array(*pairs)).alias("entry")).select("entry.*").where(F.col("count") != 0)


def host_error_ranking(events: DataFrame, is_error: Column | None = None) -> DataFrame:
    """Hosts by number of ERROR or CRITICAL lines (or of those that ``is_error`` names)."""
    if is_error is None and "_raw" in events.columns:
        is_error = error_line(F.col("_raw"))
    if is_error is None or first_present(events, HOST_FIELDS) is None:
        return _empty(events, RANKING_SCHEMA)
    return (
        events.where(is_error)
        .groupBy(host_column(events).alias("host"))
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy(F.desc("error_count"), "host")
    )


# ---------------------------------------------------------------------------
# Slow events and HTTP errors
# ---------------------------------------------------------------------------

def slow_rows(events: DataFrame, threshold_ms: float = 1000, row_id: bool = False) -> DataFrame:
    """Unordered form of :func:`detect_slow_queries`; map-only, also for streams."""
    field = first_present(events, DURATION_FIELDS)
    if field is None:
        return _empty(events, SLOW_SCHEMA)
    return events.select(
        to_double(events, field).alias("duration_ms"),
        F.lit(field).alias("field"),
        host_column(events).alias("host"),
        F.substring(optional(events, first_present(events, QUERY_FIELDS)).cast("string"), 1, 200).alias("query"),
        optional(events, "time", "timestamp").alias("time"),
        *_row_id(events, row_id),
    ).where(F.col("duration_ms") > threshold_ms)


def detect_slow_queries(events: DataFrame, threshold_ms: float = 1000) -> DataFrame:
    """Events slower than the threshold, slowest first."""
    return slow_rows(events, threshold_ms).orderBy(F.desc("duration_ms"), "time", "host")


def http_rows(events: DataFrame, row_id: bool = False) -> DataFrame:
    """Unordered form of :func:`detect_http_errors`; map-only, also for streams."""
    field = first_present(events, STATUS_FIELDS)
    if field is None:
        return _empty(events, HTTP_SCHEMA)
    status = to_bigint(events, field)
    return events.select(
        status.alias("status_code"),
        F.when(status >= 500, F.lit("5xx")).otherwise(F.lit("4xx")).alias("class"),
        F.lit(field).alias("field"),
        host_column(events).alias("host"),
        F.substring(optional(events, first_present(events, PATH_FIELDS)).cast("string"), 1, 200).alias("path"),
        optional(events, "time", "timestamp").alias("time"),
        *_row_id(events, row_id),
    ).where(F.col("status_code") >= 400)


def detect_http_errors(events: DataFrame) -> DataFrame:
    """Events with a status of 400 or more, highest first."""
    return http_rows(events).orderBy(F.desc("status_code"), "time", "host")


# ---------------------------------------------------------------------------
# Rolling z-score
# ---------------------------------------------------------------------------

def flag_outliers(events: DataFrame, field: str | None = None, window: int = 20, z_threshold: float = 3.0
                  ) -> DataFrame | None:
    """Rows whose z-score over the trailing ``window`` rows exceeds the threshold, with ``idx``
    (global position) and ``opens`` (no other flagged row among the ``window`` rows before).

    None when the columns are missing or there are not more than ``window`` timed events.
    """
    field = field or first_present(events, NUMERIC_FIELDS)
    if field is None or field not in events.columns or "time" not in events.columns:
        return None
    rows = _timed(events).select(
        micros(F.col("time")).alias("us"),
        row_order(events).alias("seq"),
        to_double(events, field).alias("value"),
        host_column(events).alias("host"),
    )
    numbered, total = number_rows(rows, "us", "seq")
    if total < window + 1:
        return None
    # a row needs the flags of `window` rows before it, and the first of those its own full frame
    order = Window.partitionBy("block").orderBy("idx")
    frame = order.rowsBetween(1 - window, 0)
    scored = (
        with_halo(numbered, 2 * window - 1)
        .withColumn("rolling_mean", F.avg("value").over(frame))
        .withColumn("rolling_std", F.stddev_samp("value").over(frame))
        .withColumn("filled", F.count("value").over(frame))
        .withColumn(
            "z_score",
            F.when(
                F.col("filled") == window,
                (F.col("value") - F.col("rolling_mean")) / F.nullif(F.col("rolling_std"), F.lit(0.0)),
            ),
        )
        .withColumn(
            "flagged",
            F.coalesce(
                ~F.isnan("z_score") & (F.abs("z_score") < F.lit(float("inf")))
                & (F.abs("z_score") > F.lit(float(z_threshold))),
                F.lit(False),
            ),
        )
        .withColumn(
            "opens", ~F.coalesce(F.max("flagged").over(order.rowsBetween(-window, -1)), F.lit(False))
        )
        .where(F.col("own") & F.col("flagged"))
        .select("idx", "us", "value", "z_score", "rolling_mean", "rolling_std", "host", "opens")
    )
    # few rows, read several times below: compute the windows once
    return materialize(scored, "outliers")


def anomaly_clusters(events: DataFrame, field: str | None = None, window: int = 20, z_threshold: float = 3.0
                     ) -> DataFrame:
    """Runs of flagged rows no more than ``window`` rows apart, led by the row of largest \\|z\\|."""
    flagged = flag_outliers(events, field, window, z_threshold)
    if flagged is None:
        return _empty(events, "cluster bigint, leader_idx bigint, leader_time timestamp, leader_z double, "
                              "members bigint, first_time timestamp, last_time timestamp")
    return _clusters(flagged).select(
        "cluster", "leader_idx", F.timestamp_micros("leader_us").alias("leader_time"), "leader_z", "members",
        F.timestamp_micros("first_us").alias("first_time"), F.timestamp_micros("last_us").alias("last_time"),
    )


def _clusters(flagged: DataFrame) -> DataFrame:
    leader = F.max(F.struct(F.abs("z_score").alias("size"), (-F.col("idx")).alias("earliest"),
                            F.col("us").alias("us"), F.col("z_score").alias("z")))
    return (
        group_numbers(flagged, "idx", F.col("opens"), "cluster")
        .groupBy("cluster")
        .agg(leader.alias("leader"), F.count(F.lit(1)).alias("members"),
             F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .select("cluster", (-F.col("leader.earliest")).alias("leader_idx"), F.col("leader.us").alias("leader_us"),
                F.col("leader.z").alias("leader_z"), "members", "first_us", "last_us")
    )


def detect_numeric_anomalies(events: DataFrame, field: str | None = None, window: int = 20,
                             z_threshold: float = 3.0) -> DataFrame:
    """Outliers by rolling z-score, largest first.

    Within a run of outliers no more than ``window`` rows apart only the largest is taken as
    genuine; the others are tagged ``window_contaminated``.
    """
    flagged = flag_outliers(events, field, window, z_threshold)
    if flagged is None:
        return _empty(events, ANOMALY_SCHEMA)
    name = field or first_present(events, NUMERIC_FIELDS)
    leaders = _clusters(flagged).select(F.col("leader_idx").alias("idx"), F.lit(True).alias("leads"))
    return (
        flagged.join(leaders, "idx", "left")
        .orderBy(F.desc(F.abs("z_score")), "idx")
        .select(
            F.lit(name).alias("field"), "value", "z_score", "rolling_mean", "rolling_std",
            F.timestamp_micros("us").alias("time"), F.col("leads").isNull().alias("window_contaminated"), "host",
        )
    )
