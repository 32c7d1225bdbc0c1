"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import HOST_FIELDS


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate that is a column of ``df`` (a schema question, not a per-row one)."""
    have = set(df.columns)
    return next((c for c in candidates if c in have), None)


def optional(df: DataFrame, name: str | None, dtype: str = "string") -> Column:
    """The named column, or a typed null when the frame does not have it."""
    if name is not None and name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(None).cast(dtype)


def host_column(df: DataFrame) -> Column:
    return optional(df, first_present(df, HOST_FIELDS)).cast("string")


def non_blank(col: Column) -> Column:
    """Null for null or empty text."""
    return F.nullif(col.cast("string"), F.lit(""))


def or_unknown(col: Column) -> Column:
    return F.coalesce(non_blank(col), F.lit("unknown"))


def micros(col: Column) -> Column:
    """Microseconds since the epoch. A zone-less timestamp counts as UTC."""
    return F.unix_micros(col.cast("timestamp"))


def floor_div(col: Column, n: int | Column) -> Column:
    """Exact floor division of a long, also for times before 1970."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", col - F.pmod(col, n), n)


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_NON_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def to_double(df: DataFrame, name: str) -> Column:
    """Lenient number: text that is not wholly a number gives null (``5d`` is not 5.0)."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        # the guard comes first, so a suffix like 5d or 5f never reaches the cast
        return F.when(col.rlike(_NUMBER) | col.rlike(_NON_FINITE), col.try_cast("double"))
    return col.try_cast("double")


def to_bigint(df: DataFrame, name: str) -> Column:
    """Lenient integer: ``404.0`` and ``abc`` give null."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(col.rlike(r"^[+-]?\d+$"), col.try_cast("bigint"))
    return col.try_cast("bigint")


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is a literal substring of ``text``.

    As a predicate on a one-element array the text is built once per row; a plain chain of
    ``contains`` in a filter builds it (with its ``lower``) again for every keyword.
    """
    def hit(t: Column) -> Column:
        found = F.contains(t, F.lit(keywords[0]))
        for keyword in keywords[1:]:
            found = found | F.contains(t, F.lit(keyword))
        return found

    return F.exists(F.array(text), hit)


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords found in ``text`` as literal substrings, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]))


def error_line(raw: Column) -> Column:
    return contains_any(F.upper(raw.cast("string")), ("ERROR", "CRITICAL"))


def row_order(df: DataFrame) -> Column:
    """Tie-break among events of equal time: the ingest ordinal, else a hash of the row."""
    if "seq" in df.columns:
        return F.col("seq").cast("bigint")
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(hashable)])
