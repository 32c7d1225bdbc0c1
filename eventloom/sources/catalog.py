"""Schema catalogue: which fields of which type each sourcetype has, seen from when until when.

Kept as a table ``sourcetype, field_name, dtype, first_seen, last_seen`` with one row per field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import materialize

CATALOG_SCHEMA = "sourcetype string, field_name string, dtype string, first_seen timestamp, last_seen timestamp"


def stored_name(dtype: T.DataType) -> str:
    """Types are stored as Spark writes them, nested ones whole; times without a zone count as UTC."""
    return "timestamp" if isinstance(dtype, T.TimestampNTZType) else dtype.simpleString()


def _stored_type(name: str) -> T.DataType:
    """The type of a stored name; one that cannot be read, such as one with odd field names, is read as text."""
    try:
        return T._parse_datatype_string(name)
    except ParseException:
        return T.StringType()


def observe_columns(events: DataFrame, seen: str = "time") -> DataFrame:
    """Fields in use per sourcetype of a typed frame.

    One aggregation with a first and last sighting per column, then an unpivot of its few rows:
    events are never multiplied by their columns.
    """
    moment = F.col(seen).cast("timestamp")
    fields = [f for f in events.schema.fields if f.name not in (seen,)]
    sightings = events.groupBy("sourcetype").agg(*[
        bound(F.when(F.col(f"`{f.name}`").isNotNull(), moment)).alias(f"{side}{i}")
        for i, f in enumerate(fields)
        for side, bound in (("first", F.min), ("last", F.max))
    ])
    entries = F.array(*[
        F.struct(F.lit(f.name).alias("field_name"), F.lit(stored_name(f.dataType)).alias("dtype"),
                 F.col(f"first{i}").alias("first_seen"), F.col(f"last{i}").alias("last_seen"))
        for i, f in enumerate(fields)
    ])
    return sightings.select("sourcetype", F.explode(entries).alias("entry")).select("sourcetype", "entry.*").where(
        F.col("first_seen").isNotNull()
    )


def observe_json(records: DataFrame, body: str, sourcetype: str, seen: str) -> DataFrame:
    """Fields with the type each value really has, from JSON objects in column ``body``; a field with
    several types gives several rows."""
    parsed = F.from_json(F.col(body), "map<string,variant>")
    typed = records.select(
        F.col(sourcetype).alias("sourcetype"), F.col(seen).cast("timestamp").alias("seen"),
        F.explode(parsed).alias("field_name", "value"),
    )
    return (
        typed.select("sourcetype", "field_name", _variant_name(F.col("value")).alias("dtype"), "seen")
        .where(F.col("dtype").isNotNull())
        .groupBy("sourcetype", "field_name", "dtype")
        .agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    )


def _variant_name(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
        .when(kind == "BIGINT", F.lit("bigint"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.lit("double"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind.startswith("ARRAY"), F.lit("array<string>"))
        .when(kind.startswith("OBJECT"), F.lit("map<string,string>"))
        .otherwise(F.lit("string"))
    )


def schema_catalog_upsert(catalog: DataFrame | None, observed: DataFrame) -> DataFrame:
    """Merge: the first sighting is kept, type and last sighting come from the newest."""
    merged = observed if catalog is None else catalog.unionByName(observed)
    return merged.groupBy("sourcetype", "field_name").agg(
        F.max_by("dtype", F.struct("last_seen", "dtype")).alias("dtype"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def schema_catalog_reset(catalog: DataFrame, observed: DataFrame, sourcetypes: Sequence[str]) -> DataFrame:
    """Replace, not merge, the fields of the given sourcetypes."""
    names = list(sourcetypes)
    kept = catalog.where(F.col("sourcetype").isNull() | ~F.col("sourcetype").isin(names))
    fresh = schema_catalog_upsert(None, observed.where(F.col("sourcetype").isin(names)))
    return kept.unionByName(fresh)


def schema_drift(observed: DataFrame) -> DataFrame:
    """Fields seen with more than one type."""
    return (
        observed.groupBy("sourcetype", "field_name")
        .agg(F.array_sort(F.collect_set("dtype")).alias("dtypes"))
        .where(F.size("dtypes") > 1)
    )


def schema_catalog_load(catalog: DataFrame, sourcetype: str) -> T.StructType | None:
    """Schema for the readers, or None for an unseen sourcetype. Reads one row per field."""
    rows = catalog.where(F.col("sourcetype") == sourcetype).orderBy("field_name").select("field_name", "dtype").collect()
    if not rows:
        return None
    return T.StructType([T.StructField(name, _stored_type(dtype)) for name, dtype in rows])


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Overwrite only the sourcetypes that ``catalog`` holds."""
    columns = T._parse_datatype_string(CATALOG_SCHEMA).fieldNames()
    # the new rows may be derived from the very files that are about to be replaced
    rows = materialize(catalog.select(*columns), "catalog")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sourcetype").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)
