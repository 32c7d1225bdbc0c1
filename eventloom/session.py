"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Correctness needs UTC and exact names; the rest lets Spark re-plan joins and split skewed partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # exports hold fields that differ only by case (Source and source), which must stay apart
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sizing_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition settings for an input size: shuffles start with about one partition per
    ``partition_bytes`` and are merged at run time where less data arrives."""
    partitions = str(max(200, -(-input_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine (a ``local`` master, as in tests) a temporary
    folder is used and remembered in the session. On a cluster executors would not see it, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("eventloom.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("eventloom.scratch.dir", root)
    return root.rstrip("/")


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet (with the writer's ``options``) in the scratch folder and return the table.

    Used where several consumers must see the very same rows (ids handed out by position)
    or where recomputing would repeat an expensive stage. Unlike an executor-local cache the
    written table survives the loss of executors, and its readers still prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, sources: int, each: int) -> DataFrame:
    """``df`` in no more parts than one per ``each`` of the ``sources`` rows that it is made from, or one per core.

    For tables about to be written. Where Spark does not merge small shuffle partitions itself, every one of them writes a
    file of its own, however small the table, and each file costs calls of the file system (on a local disk without
    Hadoop's native library three processes that the executor starts). Parts are worked on one after another in a task
    and never split or moved, so memory is that of one part.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, cores, -(-sources // each)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, removed with the scope it is made in."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _written.get() is not None:
        _written.get().append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove on exit what was materialized inside; for loops and services.

    Results that are needed later must have been written before the scope ends.
    """
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            remove_path(spark, path)
        _written.reset(token)
