"""Event time from text: epoch seconds, ISO-8601 with a zone, or US month/day/year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms. An ISO time without a zone is not accepted.
EPOCH_FORM = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_FORM = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$"
US_FORM = r"^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
ISO_PATTERN = "yyyy-M-d'T'H:m:s[.SSSSSS][XXX][XX]"
US_PATTERN = "M/d/yyyy H:m:s"

# Years 1 to 9999 as epoch seconds.
EPOCH_MIN = -62135596800
EPOCH_END = 253402300800


def event_time(col: Column) -> Column:
    """UTC timestamp of ``col``; null when the text has none of the accepted forms."""
    text = col.cast("string")
    seconds = F.trim(text).try_cast("double")
    whole = seconds.try_cast("bigint")
    # the fraction is rounded on its own, half to even, so that no digits are lost to the epoch's size
    epoch_us = whole * F.lit(1_000_000) + F.rint((seconds - whole) * F.lit(1e6)).cast("bigint")
    in_range = (seconds >= F.lit(EPOCH_MIN)) & (seconds < F.lit(EPOCH_END))
    return (
        F.when(text.rlike(EPOCH_FORM), F.when(in_range, F.timestamp_micros(epoch_us)))
        .when(text.rlike(ISO_FORM), F.try_to_timestamp(text, F.lit(ISO_PATTERN)))
        .when(
            text.rlike(US_FORM),
            F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit(US_PATTERN)),
        )
    )
