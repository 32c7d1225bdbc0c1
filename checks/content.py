"""Findings of all kinds in one shape, so that whole bundles can be compared: kind, texts, numbers, times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS, NUMBERS, TIMES = 6, 4, 2

#: Texts, numbers and times of each kind; together all of its columns.
FIELDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "spikes": (("hosts",), ("event_count", "window_seconds", "threshold"), ("window_start",)),
    "patterns": (("type", "sourcetype", "error_code", "prefix"), ("count",), ()),
    "cert_anomalies": (("type", "host", "matched_keywords", "sourcetype", "raw_excerpt"), (), ("time",)),
    "correlations": (("hosts", "sourcetypes"), ("span_seconds", "event_count"), ("group_start", "group_end")),
    "severity": (("level",), ("count",), ()),
    "host_ranking": (("host",), ("error_count",), ()),
    "slow_queries": (("field", "host", "query"), ("duration_ms",), ("time",)),
    "numeric_anomalies": (("field", "host", "window_contaminated"), ("value", "z_score", "rolling_mean", "rolling_std"), ("time",)),
    "event_pairs": (("entity_field", "entity", "first_pattern", "second_pattern", "first_raw_excerpt", "second_raw_excerpt"),
                    ("span_seconds",), ("first_time", "second_time")),
    "event_count": ((), ("event_count",), ()),
    "host_isolation": (("host", "sourcetype", "error_code"), ("count",), ()),
    "api_errors": (("host", "uri"), ("status", "count"), ()),
    "database_slowdown": (("host",), ("avg_ms", "max_ms", "count"), ()),
    "cascading_failure": (("host",), ("duration", "eventcount"), ("time",)),
    "timeline": (("host",), ("count",), ("minute",)),
    "first_occurrence": (("host", "sourcetype", "message"), (), ("time",)),
}


def _shaped(kind: str, found: DataFrame) -> DataFrame:
    texts, numbers, times = FIELDS[kind]
    assert {*texts, *numbers, *times} == set(found.columns), (kind, found.columns)

    def text(name: str):
        many = isinstance(found.schema[name].dataType, T.ArrayType)
        return F.array_join(name, ",") if many else F.col(name).cast("string")

    def padded(columns, n: int, dtype: str, prefix: str):
        return [c.cast(dtype).alias(f"{prefix}{i}") for i, c in enumerate([*columns, *[F.lit(None)] * (n - len(columns))])]

    return found.select(
        F.lit(kind).alias("kind"), *padded([text(c) for c in texts], TEXTS, "string", "text"),
        *padded([F.col(c) for c in numbers], NUMBERS, "double", "number"), *padded([F.col(c) for c in times], TIMES, "timestamp", "time"))


def content(found: dict[str, DataFrame]) -> DataFrame:
    """Every row of every kind with all its fields."""
    return reduce(DataFrame.unionByName, (_shaped(kind, rows) for kind, rows in found.items()))


def content_of_json(found: dict[str, DataFrame], rows: DataFrame, options: dict[str, str]) -> DataFrame:
    """The same from JSON bodies (``type, body_json``) of these kinds."""
    return content({
        kind: rows.where(F.col("type") == kind).select(F.from_json("body_json", like.schema, options).alias("b")).select("b.*")
        for kind, like in found.items()})


def content_sql(queries: dict[str, str]) -> str:
    """The same from SQL with the kinds' columns."""
    parts = []
    for kind, sql in queries.items():
        texts, numbers, times = FIELDS[kind]
        columns = [f"'{kind}' as kind"]
        for prefix, n, dtype, names in (("text", TEXTS, "varchar", texts), ("number", NUMBERS, "double", numbers),
                                        ("time", TIMES, "timestamp", times)):
            columns += [f'cast({chr(34) + names[i] + chr(34) if i < len(names) else "null"} as {dtype}) as {prefix}{i}' for i in range(n)]
        parts.append(f"select {', '.join(columns)} from ({sql})")
    return " union all ".join(parts)
