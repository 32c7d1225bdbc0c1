"""Text forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(time: Column) -> Column:
    """ISO-8601 in UTC; the fraction is shown only when there is one. Expects a UTC session."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.pmod(F.unix_micros(time), F.lit(1_000_000)) != 0, F.date_format(time, ".SSSSSS"))
    return F.concat(whole, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def two_decimals(number: Column) -> Column:
    """Two digits, ties to even. Rounded to six digits first, so that the last bits of a mean, which
    depend on the order of the sum, do not decide a tie."""
    return F.call_function("format_number", F.round(number, 6), F.lit("0.00"))
