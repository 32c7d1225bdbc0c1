from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventloom.functions import event_time, relative_time
from eventloom.operators import normalize as N

UTC = timezone.utc


def at(*parts):
    return datetime(*parts)


@pytest.mark.parametrize("text,want", [
    ("1719500000", at(2024, 6, 27, 14, 53, 20)),
    (" 1719500000.25 ", at(2024, 6, 27, 14, 53, 20, 250000)),
    ("1719500000.123457", at(2024, 6, 27, 14, 53, 20, 123457)),
    ("-1.5", at(1969, 12, 31, 23, 59, 58, 500000)),
    ("2026-06-27T14:32:15Z", at(2026, 6, 27, 14, 32, 15)),
    ("2026-06-27T14:32:15.1+00:00", at(2026, 6, 27, 14, 32, 15, 100000)),
    ("2026-06-27T14:32:15.123456+0200", at(2026, 6, 27, 12, 32, 15, 123456)),
    ("6/7/2026 1:02:03", at(2026, 6, 7, 1, 2, 3)),
    ("2026-06-27T14:32:15", None),
    ("2026-06-27 14:32:15", None),
    ("2026-13-27T14:32:15Z", None),
    ("nan", None), ("inf", None), ("1e300", None), ("5d", None), ("None", None), ("null", None), ("", None), (None, None),
    ("garbage", None),
])
def test_event_time(spark, text, want):
    df = spark.createDataFrame([(text,)], "_time string").select(event_time(F.col("_time")).cast("timestamp_ntz").alias("t"))
    assert df.first()["t"] == want


def test_timestamps_without_time_column(spark):
    assert N.extract_timestamps(spark.range(1)).first()["time"] is None


def test_cert_struct_has_one_type(spark):
    with_field = N.extract_cert_fields(spark.createDataFrame([("timeout",)], "ocsp_status string"))
    without = N.extract_cert_fields(spark.range(1))
    assert with_field.schema["cert"].dataType == without.schema["cert"].dataType
    assert with_field.first()["cert"]["ocsp_status"] == "timeout" and without.first()["cert"] is None


def test_timeline_offsets(spark):
    df = spark.createDataFrame([("1000",), ("1002.5",), ("x",)], "_time string")
    got = {r["_time"]: r["relative_offset_s"] for r in N.prepare_events(df).collect()}
    assert got == {"1000": 0.0, "1002.5": 2.5, "x": 0.0}
    unknown = N.prepare_events(spark.createDataFrame([("x",)], "_time string"))
    assert unknown.first()["relative_offset_s"] == 0.0


def test_effective_host_falls_through_blanks(spark):
    df = spark.createDataFrame([("h", "s", "n"), ("", "s", "n"), (None, None, "n"), ("", "", None)],
                               "host string, src string, hostname string")
    assert [r["effective_host"] for r in N.effective_host(df).collect()] == ["h", "s", "n", "unknown"]
    assert {r["effective_host"]: r["event_count"] for r in N.group_by_host(df).collect()}["unknown"] == 1


def test_append_unions_by_name_and_settles_types(spark):
    one = spark.createDataFrame([("x", 1)], "value string, a int")
    two = spark.createDataFrame([(["p", "q"], 2)], "value array<string>, b int")
    rows = N.append_events(one, two).collect()
    assert [(r["value"], r["a"], r["b"]) for r in rows] == [("x", 1, None), ('["p","q"]', None, 2)]


def test_append_widens_numbers(spark):
    a, b = spark.createDataFrame([(1, 2)], "n int, m int"), spark.createDataFrame([(0.5, 1 << 40)], "n double, m bigint")
    both = N.append_events(a, b)
    assert dict(both.dtypes) == {"n": "double", "m": "bigint"} and both.count() == 2


def test_prepared_frames_with_and_without_cert_union(spark):
    one = N.prepare_events(spark.createDataFrame([("1", "timeout")], "_time string, ocsp_status string"))
    two = N.prepare_events(spark.createDataFrame([("2",)], "_time string"))
    assert N.append_events(one, two).count() == 2


@pytest.mark.parametrize("modifier,want", [
    ("now", at(2026, 1, 2)), ("-24h", at(2026, 1, 1)), ("-15m", at(2026, 1, 1, 23, 45)), ("+1h", at(2026, 1, 2, 1)),
    ("-2d", at(2025, 12, 31)), ("2026-01-01T05:00:00Z", at(2026, 1, 1, 5)), ("2026-01-01T05:00:00+02:00", at(2026, 1, 1, 3)),
])
def test_relative_time(modifier, want):
    got = relative_time(modifier, datetime(2026, 1, 2, tzinfo=UTC))
    assert got == want.replace(tzinfo=UTC)
    with pytest.raises(ValueError):
        relative_time("soon", datetime(2026, 1, 2))
