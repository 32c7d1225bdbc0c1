"""History tables in Parquet below one root folder. All writes append; state is derived on read."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import PROMOTED_FIELDS
from eventloom.functions import non_blank, optional
from eventloom.plans.findings import Findings, findings_long
from eventloom.plans.history import RUN_FIELDS, parse_query_blocks

REPORT_SCHEMA = ("run_id string, id bigint, created_at timestamp, source_file string, report_md string, spl string, "
                 "earliest string, latest string")
REPORT_LINE = ("section", "part", "rank", "tie", "line")
QUERY_SCHEMA = ("run_id string, id bigint, created_at timestamp, iteration int, area string, spl string, "
                "executed boolean, result_rows bigint")
ALERT_SCHEMA = "alert_id string, run_id string, ts timestamp, severity string, summary string, detail_json string"
ACK_SCHEMA = "alert_id string, acked_at timestamp"
RUN_SCHEMA = ("run_id string, id bigint, updated_at timestamp, cleared boolean, source string, iteration int, "
              "confidence string, events bigint, pause_requested boolean, hint string, findings_json string")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _next_id() -> int:
    """Grows from write to write, which is all the order of a history needs."""
    return time.time_ns()


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The table, or an empty frame of its type before the first write."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}").select(*T._parse_datatype_string(schema).fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- events -----------------------------------------------------------------

def event_rows(events: DataFrame, run_id: str) -> DataFrame:
    """Stored form: promoted columns as text (null becomes empty), everything else as JSON."""
    promoted = [F.coalesce(optional(events, c).cast("string"), F.lit("")).alias(c) for c in PROMOTED_FIELDS]
    rest = [F.col(f"`{c}`") for c in events.columns if c not in PROMOTED_FIELDS]
    extra = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return events.select(*promoted, extra.alias("extra_json"), F.lit(run_id).alias("run_id"))


def write_events(events: DataFrame, root: str, run_id: str) -> None:
    event_rows(events, run_id).write.mode("append").partitionBy("run_id").parquet(f"{root}/events")


def load_run_events(spark: SparkSession, root: str, run_id: str, extra: T.StructType | str | None = None
                    ) -> DataFrame:
    """Events of a run ordered by ``_time`` as text. With ``extra`` (a schema) the other fields are
    unpacked into columns, else they come as a map of text."""
    stored = spark.read.parquet(f"{root}/events").where(F.col("run_id") == run_id).drop("run_id")
    return unpack_extra(stored, extra).orderBy("_time")


def unpack_extra(stored: DataFrame, extra: T.StructType | str | None = None) -> DataFrame:
    if extra is None:
        return stored.withColumn("extra", F.from_json("extra_json", "map<string,string>")).drop("extra_json")
    return stored.withColumn("extra", F.from_json("extra_json", extra)).select(*PROMOTED_FIELDS, "extra.*")


# --- findings, reports, queries ---------------------------------------------

def write_findings(findings: Findings, root: str, run_id: str) -> None:
    (
        findings_long(findings)
        .withColumn("created_at", F.lit(_now()))
        .withColumn("run_id", F.lit(run_id))
        .write.mode("append").partitionBy("run_id").parquet(f"{root}/findings")
    )


def write_report(spark: SparkSession, root: str, run_id: str, report: str | DataFrame, source_file: str = "", spl: str = "",
                 earliest: str = "", latest: str = "") -> int:
    """Add a report to the history and return its id.

    A laid-out report (the rows of ``findings_report``) is stored as rows, whatever its length, and read back by
    ``read_report``; the history's own text then is the line that states the confidence, if there is one.
    """
    number = _next_id()
    if isinstance(report, str):
        text = report
    else:
        (report.select(F.lit(run_id).alias("run_id"), F.lit(number).alias("id"), *REPORT_LINE)
         .write.mode("append").partitionBy("run_id", "id").parquet(f"{root}/report_lines"))
        stated = report.where(F.col("line").startswith("**Confidence:**")).agg(F.min("line")).first()
        text = stated[0] or ""
    row = (run_id, number, _now(), source_file, text, spl, earliest, latest)
    spark.createDataFrame([row], REPORT_SCHEMA).write.mode("append").parquet(f"{root}/reports")
    return number


def read_report(spark: SparkSession, root: str, run_id: str, number: int) -> DataFrame:
    """The lines of a report stored as rows, in order; only its own folder is read."""
    lines = spark.read.parquet(f"{root}/report_lines").where((F.col("run_id") == run_id) & (F.col("id") == number))
    return lines.orderBy("section", "part", "rank", "tie", "line").select(*REPORT_LINE)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """A laid-out report as text; Spark writes it, so its length does not matter."""
    lines.select("line").write.mode("overwrite").text(path)


def write_queries(spark: SparkSession, root: str, run_id: str, iteration: int, blocks: list[str],
                  result_rows: list[int | None] | None = None) -> None:
    """The query blocks of one iteration (a handful, given by the caller)."""
    first = _next_id()
    rows = [
        (run_id, first + i, _now(), iteration, result_rows is not None,
         result_rows[i] if result_rows and i < len(result_rows) else None, block)
        for i, block in enumerate(blocks)
    ]
    given = spark.createDataFrame(
        rows, "run_id string, id bigint, created_at timestamp, iteration int, executed boolean, result_rows bigint, "
              "block string")
    columns = [field.name for field in T._parse_datatype_string(QUERY_SCHEMA).fields]
    parse_query_blocks(given).select(*columns).write.mode("append").parquet(f"{root}/investigation_queries")


# --- alerts -----------------------------------------------------------------

def alert_rows(hits: DataFrame, run_id: str) -> DataFrame:
    """Stored form of tagged hits; the id is a digest of the hit and of its event, so the same hit has one id and equal hits
    of different events have several."""
    return hits.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "detector", "detail_json", optional(hits, "row_id")), 256).alias("alert_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(_now()).alias("ts"),
        F.coalesce(non_blank(F.col("severity")), F.lit("warning")).alias("severity"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "detail_json",
    )


def path_part(name: str) -> str:
    """A name as one folder of a path, whatever it consists of."""
    return quote(name, safe="")


def store_alerts(rows: DataFrame, root: str, run_id: str, batch: str) -> None:
    """The one layout of stored alerts: a folder per run and batch. A batch written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{root}/alerts/of_run={path_part(run_id)}/batch={path_part(batch)}")


def write_alerts(hits: DataFrame, root: str, run_id: str) -> None:
    store_alerts(alert_rows(hits, run_id), root, run_id, f"once-{uuid.uuid4()}")


def alerts_ack(spark: SparkSession, root: str, alert_ids: list[str]) -> None:
    now = _now()
    spark.createDataFrame([(a, now) for a in alert_ids], ACK_SCHEMA).write.mode("append").parquet(f"{root}/acks")


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "alerts", ALERT_SCHEMA)


def read_acks(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "acks", ACK_SCHEMA)


# --- runs -------------------------------------------------------------------

def log_run_update(spark: SparkSession, root: str, run_id: str, **fields) -> None:
    """Record changed fields of a run; unknown names are ignored."""
    known = [fields.get(name) for name in RUN_FIELDS]
    row = (run_id, _next_id(), _now(), False, *known)
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{root}/active_runs")


def clear_run(spark: SparkSession, root: str, run_id: str) -> None:
    row = (run_id, _next_id(), _now(), True, *([None] * len(RUN_FIELDS)))
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{root}/active_runs")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "active_runs", RUN_SCHEMA)


def new_run_id() -> str:
    return str(uuid.uuid4())
