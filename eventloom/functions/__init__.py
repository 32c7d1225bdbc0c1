from eventloom.functions.columns import (
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
from eventloom.functions.reltime import relative_time
from eventloom.functions.timeparse import event_time

__all__ = [
    "contains_any", "error_line", "event_time", "first_present", "floor_div", "matched_keywords",
    "micros", "non_blank", "optional", "or_unknown", "relative_time", "row_order", "to_bigint", "to_double",
]
