"""Normalisation: event time, certificate fields, timeline offset, effective host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import CERT_FIELDS, HOST_FIELDS
from eventloom.functions import event_time, micros, non_blank

CERT_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in CERT_FIELDS])


def extract_timestamps(events: DataFrame) -> DataFrame:
    """Add ``time`` (UTC) parsed from ``_time``; all null when there is no ``_time``."""
    if "_time" not in events.columns:
        return events.withColumn("time", F.lit(None).cast("timestamp"))
    if isinstance(events.schema["_time"].dataType, (T.TimestampType, T.TimestampNTZType)):
        return events.withColumn("time", F.col("_time").cast("timestamp"))
    return events.withColumn("time", event_time(F.col("_time")))


def extract_cert_fields(events: DataFrame) -> DataFrame:
    """Add ``cert``: one struct of the nine certificate fields, null if the frame has none of them.

    The struct type never varies, so frames with different columns still union.
    """
    present = set(CERT_FIELDS) & set(events.columns)
    if not present:
        return events.withColumn("cert", F.lit(None).cast(CERT_TYPE))
    fields = [
        (F.col(name) if name in present else F.lit(None)).cast("string").alias(name)
        for name in CERT_FIELDS
    ]
    return events.withColumn("cert", F.struct(*fields))


def build_timeline(events: DataFrame) -> DataFrame:
    """Add ``relative_offset_s``: seconds since the earliest event, 0.0 for an unknown time.

    The earliest time is a scalar subquery, so the events are neither sorted nor shuffled;
    order them only where they are shown.
    """
    if "time" not in events.columns:
        return events.withColumn("relative_offset_s", F.lit(0.0))
    first_us = events.agg(F.min(micros(F.col("time")))).scalar()
    offset = (micros(F.col("time")) - first_us) / F.lit(1e6)
    return events.withColumn("relative_offset_s", F.coalesce(offset, F.lit(0.0)))


def prepare_events(events: DataFrame, with_cert: bool = True) -> DataFrame:
    events = extract_timestamps(events)
    if with_cert:
        events = extract_cert_fields(events)
    return build_timeline(events)


def effective_host(events: DataFrame) -> DataFrame:
    """Add ``effective_host``: first non-blank of host, src, hostname, else ``unknown``."""
    candidates = [non_blank(F.col(name)) for name in HOST_FIELDS if name in events.columns]
    return events.withColumn("effective_host", F.coalesce(*candidates, F.lit("unknown")))


def group_by_host(events: DataFrame) -> DataFrame:
    """Per effective host: number of events, first and last time.

    The rows of one host are ``effective_host(events).where(...)``; as a layout on disk,
    write with ``partitionBy("effective_host")``.
    """
    if "time" not in events.columns:
        events = events.withColumn("time", F.lit(None).cast("timestamp"))
    return (
        effective_host(events)
        .groupBy("effective_host")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
        )
    )


def append_events(events: DataFrame, more: DataFrame) -> DataFrame:
    """Union by column name; columns that one side lacks become null.

    Different numbers widen: whole ones to bigint, otherwise to double. Where the types of a column really conflict
    (a scalar in one, a list in the other), both turn into text: lists as JSON.
    """
    left, right = events, more
    for field in events.schema.fields:
        if field.name not in more.columns:
            continue
        types = (field.dataType, more.schema[field.name].dataType)
        if types[0] == types[1]:
            continue
        if all(isinstance(t, T.NumericType) for t in types):
            wide = "bigint" if all(isinstance(t, T.IntegralType) for t in types) else "double"
            left = left.withColumn(field.name, F.col(f"`{field.name}`").cast(wide))
            right = right.withColumn(field.name, F.col(f"`{field.name}`").cast(wide))
        else:
            left = left.withColumn(field.name, _as_text(events, field.name))
            right = right.withColumn(field.name, _as_text(more, field.name))
    return left.unionByName(right, allowMissingColumns=True)


def _as_text(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")
