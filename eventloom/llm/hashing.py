"""Bounded samples by hash: the same rows in each run, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of smallest key hash (each task keeps that many at most, so the merge is bounded too)."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(limit)
