"""Views that give the driver's tables the shape of a log and of the history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_columns(events: DataFrame) -> DataFrame:
    """The ``events`` table (or a stream of it) as log lines."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    is_error = F.col("event_type") == "error"
    return events.withColumn("k", k).select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("time"),
        F.concat(F.lit("web-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("host"),
        F.concat(F.lit("app:"), "event_type").alias("sourcetype"),
        F.concat(F.lit("/var/log/"), "event_type", F.lit(".log")).alias("source"),
        F.when(F.col("user_id") % 2 == 0, "shop").otherwise("api").alias("app"),
        F.concat(F.lit("E"), (F.col("k") % 20).cast("string")).alias("error_code"),
        F.col("value").alias("duration_ms"),
        F.col("k").alias("active_threads"),
        F.when(~is_error, F.when(F.col("k") % 10 == 0, 302).otherwise(200))
        .when(F.col("k") % 3 == 0, 503)
        .when(F.col("k") % 3 == 1, 404)
        .otherwise(500)
        .alias("status"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("k") % 7).cast("string")).alias("uri"),
        F.when(~is_error, F.concat(F.lit("INFO "), "event_type", F.lit(" served k="), F.col("k").cast("string")))
        .when(F.col("k") % 5 == 0, F.concat(F.lit("ERROR OCSP validation failed for cert "), F.col("k").cast("string")))
        .when(F.col("k") % 5 == 1, "CRITICAL TLS handshake failed")
        .when(F.col("k") % 5 == 2, "ERROR connection pool exhausted, queue full")
        .when(F.col("k") % 5 == 3, "WARN Full GC pause observed")
        .otherwise("WARNING socket in CLOSE_WAIT state")
        .alias("_raw"),
    )


def sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))
