"""Column handling shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rows of one Arrow batch are worked on in slices of about this many bytes of text.
SLICE_BYTES = 16 << 20
# Documents whose texts, or whose narrow rows, one task at least writes (see ``gathered``).
TEXTS_PER_TASK = 1 << 12
ROWS_PER_TASK = 1 << 14


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``__c0, __c1, ...``, so that no name can clash with a helper's."""
    return df.toDF(*(f"__c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``positional`` calls the column: the first of exactly this name."""
    return f"__c{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, resolved by exact name whatever other columns there are."""
    numbered = positional(df)
    return numbered.select(*(F.col(place(df, name)).alias(name) for name in names))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of ``column`` each, one row at least.

    Bounds what a Python worker builds at once without cutting a text.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, length in enumerate(lengths):
        if total and total + length > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)
