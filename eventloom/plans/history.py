"""Questions to the history tables: past queries, reports, alerts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import DEFAULTS
from eventloom.operators.ordered import prefix

# Text forms of a report's confidence line and of a query block.
CONFIDENCE = r"(?i)\*\*Confidence:\*\*\s*(High|Medium|Low)"
CONFIDENCE_HIGH = r"(?i)\*\*Confidence:\*\*\s*High"
BLOCK_AREA = r"^--\s*(\w+)\s*\n"
BLOCK_COMMENT = r"(?m)^--\s*\w+\s*\n"

RUN_FIELDS = ("source", "iteration", "confidence", "events", "pause_requested", "hint", "findings_json")


# --- past queries -----------------------------------------------------------

def parse_query_blocks(blocks: DataFrame, column: str = "block") -> DataFrame:
    """Split a block into ``area`` (its leading ``-- area`` line) and ``spl`` (the rest)."""
    text = F.regexp_replace(F.regexp_replace(F.col(column), r"^\s+", ""), r"\s+$", "")
    query = F.regexp_replace(text, BLOCK_COMMENT, "")
    return blocks.withColumn("area", F.regexp_extract(text, BLOCK_AREA, 1)).withColumn(
        "spl", F.regexp_replace(F.regexp_replace(query, r"^\s+", ""), r"\s+$", "")
    )


def query_examples(queries: DataFrame, area: str = "", limit: int = 20, sort: str = "recent") -> DataFrame:
    """A page of past queries: the newest, or (``effective``) those that returned most rows."""
    chosen = queries.where(F.col("area") == area) if area else queries
    if sort == "effective":
        order = [F.desc_nulls_last("result_rows"), F.desc("id")]
    else:
        order = [F.desc("id")]
    return chosen.orderBy(*order).limit(limit).select("area", "spl", "result_rows", "run_id", "iteration")


def query_examples_recent(queries: DataFrame, area: str = "", limit: int = 20) -> DataFrame:
    return query_examples(queries, area, limit, "recent")


def query_examples_effective(queries: DataFrame, area: str = "", limit: int = 20) -> DataFrame:
    return query_examples(queries, area, limit, "effective")


def query_area_stats(queries: DataFrame, area: str = "") -> DataFrame:
    """Per area over all executed queries: how many, mean and exact median of the rows returned.

    The median is read off running counts over the distinct values of an area, which are computed in
    blocks of values: no area is gathered in one place. An even number of values has two middle ones.
    """
    chosen = queries.where(F.col("area") == area) if area else queries
    values = (
        chosen.where(F.col("executed").cast("boolean") & F.col("result_rows").isNotNull())
        .groupBy(F.coalesce("area", F.lit("")).alias("area"), F.col("result_rows").cast("bigint").alias("rows"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = values.groupBy("area").agg(
        F.sum("n").alias("executed_count"),
        (F.sum(F.col("rows") * F.col("n")) / F.sum("n")).alias("avg_result_rows"),
    )
    holds_middle = (2 * F.col("before") <= F.col("executed_count")) & (
        2 * (F.col("before") + F.col("n")) >= F.col("executed_count"))
    return (
        prefix(values, "rows", "n", "before", by=("area",))
        .join(totals, "area")
        .where(holds_middle)
        .groupBy("area", "executed_count", "avg_result_rows")
        .agg(((F.min("rows") + F.max("rows")) / F.lit(2)).alias("median_result_rows"))
    )


def run_queries(queries: DataFrame, run_id: str) -> DataFrame:
    return (
        queries.where(F.col("run_id") == run_id)
        .orderBy("iteration", "id")
        .select("iteration", "area", "spl", "executed", "result_rows", "created_at")
    )


# --- reports ----------------------------------------------------------------

def confidence_level(report: Column) -> Column:
    """High, Medium or Low as written in the report, else a dash."""
    return F.coalesce(F.nullif(F.regexp_extract(report, CONFIDENCE, 1), F.lit("")), F.lit("—"))


def confidence_flag(report: Column) -> Column:
    return F.when(F.coalesce(report.rlike(CONFIDENCE_HIGH), F.lit(False)), F.lit("High")).otherwise(F.lit("Medium"))


def run_history(reports: DataFrame) -> DataFrame:
    """All reports, newest first."""
    return reports.orderBy(F.desc("created_at"), F.desc("id")).select(
        "run_id",
        F.coalesce(F.nullif("source_file", F.lit("")), F.lit("—")).alias("source"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
        confidence_level(F.col("report_md")).alias("confidence"),
    )


def run_detail(reports: DataFrame, queries: DataFrame) -> DataFrame:
    """The latest report of every run with that run's queries, one row per query."""
    latest = reports.groupBy("run_id").agg(
        F.max_by(
            F.struct(
                F.coalesce(F.nullif("source_file", F.lit("")), F.lit("—")).alias("source"),
                F.coalesce("report_md", F.lit("")).alias("report_md"),
                F.coalesce("spl", F.lit("")).alias("report_spl"),
                F.coalesce("earliest", F.lit("")).alias("earliest"),
                F.coalesce("latest", F.lit("")).alias("latest"),
            ),
            F.struct("created_at", "id"),
        ).alias("report")
    ).select("run_id", "report.*")
    asked = queries.select("run_id", "iteration", "area", "spl", "executed", "result_rows")
    # an inner join can be split where one run has most queries, an outer one cannot
    silent = latest.join(asked.select("run_id").distinct(), "run_id", "left_anti")
    return latest.join(asked, "run_id").unionByName(silent, allowMissingColumns=True)


# --- alerts -----------------------------------------------------------------

def alerts_view(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their ``acked`` flag; acknowledgements are an append-only table of ids."""
    acked = acks.select("alert_id").distinct().withColumn("acked", F.lit(True))
    return alerts.join(acked, "alert_id", "left").withColumn("acked", F.coalesce("acked", F.lit(False)))


def alerts_open(alerts: DataFrame, acks: DataFrame, severity: str | None = None, acked: bool = False) -> DataFrame:
    """Alerts not yet acknowledged (or those that are), newest first."""
    chosen = alerts.where(F.col("severity") == severity) if severity else alerts
    chosen = alerts_view(chosen, acks).where(F.col("acked") == acked)
    return chosen.orderBy(F.desc("ts"), F.desc("alert_id"))


# --- runs -------------------------------------------------------------------

def latest_run_status(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """Current state of one run, or of the run updated last.

    ``log`` holds one row per update; a null field was not part of that update. A row with
    ``cleared`` ends what came before it.
    """
    chosen = log.where(F.col("run_id") == run_id) if run_id else log
    moment = F.struct("updated_at", "id")
    cleared = F.col("cleared")
    # a clearing row counts as the newest value of every field, namely none
    state = chosen.groupBy("run_id").agg(
        *[F.max_by(F.when(~cleared, F.col(name)), F.when(cleared | F.col(name).isNotNull(), moment)).alias(name)
          for name in RUN_FIELDS if name in log.columns],
        F.max(F.when(~cleared, moment)).alias("moment"),
        F.max(F.when(cleared, moment)).alias("cleared_at"),
    ).where(F.col("moment").isNotNull() & (F.col("cleared_at").isNull() | (F.col("moment") > F.col("cleared_at"))))
    out = state.withColumn("updated_at", F.col("moment.updated_at")).drop("cleared_at")
    if run_id is None:
        out = out.orderBy(F.desc("moment")).limit(1)
    return out.drop("moment")


def investigation_status(steps: DataFrame, max_iterations: int = DEFAULTS.max_iterations) -> DataFrame:
    """Whether an investigation goes on, from its report, iteration, queries and new rows."""
    high = confidence_flag(F.col("report")) == "High"
    return steps.withColumn("confidence", confidence_flag(F.col("report"))).withColumn(
        "status",
        F.when(high, F.lit("done"))
        .when(F.col("iteration") >= max_iterations, F.lit("done"))
        .when(F.coalesce("n_queries", F.lit(0)) == 0, F.lit("done"))
        .when(F.coalesce("n_new", F.lit(0)) == 0, F.lit("done"))
        .otherwise(F.lit("continue")),
    )
