"""Grouping per key with a maximum span, parallel also within one hot key.

A group opens at the first event after the previous group's reach (its start plus ``maxspan``) and takes every event up to
its own reach. Each start depends on the one before, so a key is one chain, which is solved by composed jumps:

1. A key's time is cut into cells as wide as the span, which hold one start at most, and runs of cells into leaves
   of about ``LEAF_ROWS`` distinct instants. A cell with more than that is a leaf of its own and is only handled by
   joins and sums. Most keys are one leaf and done in one task.
2. A jump leads from an event at which the chain may enter a leaf to the event at which it then enters a later one. A chain
   can enter at any event of the leaf's first cell, or at the first event behind it.
3. Jumps over two neighbouring ranges of leaves are joined to jumps over both, until one range holds a key's leaves: as many
   rounds as the number of leaves has bits, each with half the rows of the one before.
4. Walking down from the whole key, whose chain begins at its first event, the same jumps tell where the chain enters
   each half, and so each leaf.
5. Each leaf walks its part of the chain. Events before a leaf's first start belong to the last start before the leaf.

No task holds a key: a leaf has at most ``LEAF_ROWS`` instants and one cell more, and dense cells are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import floor_div, micros
from eventloom.operators.ordered import US, prefix
from eventloom.session import materialize

TRANSACTION_SCHEMA = "{field} string, start_time timestamp, end_time timestamp, duration double, event_count bigint"
LEAF_ROWS = 1 << 16
PART = "key string, leaf bigint, start_us bigint, end_us bigint, n bigint"


def transaction(events: DataFrame, field: str, maxspan_seconds: int = 3600, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Groups of one ``field`` value's events, none of which spans more than ``maxspan_seconds``."""
    if field not in events.columns or "time" not in events.columns:
        return events.sparkSession.createDataFrame([], TRANSACTION_SCHEMA.format(field=field))
    span = maxspan_seconds * US
    # a marker before the text keeps null and empty keys apart and free of nulls
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{field}`").cast("string")), F.lit(""))
    times = materialize(
        events.where(F.col("time").isNotNull())
        .select(key.alias("key"), micros(F.col("time")).alias("us"))
        .groupBy("key", "us").agg(F.count(F.lit(1)).alias("n")), "transaction-times")
    # two starts are always further apart than the span: at most one per cell
    cell = floor_div(F.col("us"), span + 1)
    cells = materialize(_leaves(times.withColumn("cell", cell), leaf_rows, span), "transaction-leaves")
    levels = (cells.agg(F.max("leaf")).first()[0] or 0).bit_length()
    placed = times.withColumn("cell", cell).join(cells, ["key", "cell"])
    if levels:
        placed = materialize(placed, "transaction-placed")
    parts = _walk(placed, _entries(placed, span, levels), span)
    if levels:
        parts = _heads(materialize(parts, "transaction-parts"))
    return (
        parts.groupBy("key", "start_us")
        .agg(F.max("end_us").alias("end_us"), F.sum("n").alias("event_count"))
        .select(
            F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(field),
            F.timestamp_micros("start_us").alias("start_time"),
            F.timestamp_micros("end_us").alias("end_time"),
            ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration"),
            "event_count",
        )
    )


def _leaves(times: DataFrame, leaf_rows: int, span: int) -> DataFrame:
    """``key, cell, leaf, dense, opens, first_us``: the leaf of each cell, numbered from 0 per key; whether the leaf is a
    single cell of too many rows; whether the cell is the leaf's first one; and the leaf's first event."""
    rows = times.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("rows"), F.min("us").alias("first_us"))
    # cells as narrow as a microsecond need more levels than cells of a second or more
    counted = prefix(rows, "cell", "rows", "before", level=2 if span >= US else 3, by=("key",))
    dense = F.col("rows") > leaf_rows
    numbered = counted.withColumn("dense", dense).withColumn(
        "run", floor_div(F.col("before"), leaf_rows) * 2 + dense.cast("bigint"))
    runs = numbered.groupBy("key", "run").agg(F.min("cell").alias("first_cell"), F.min("first_us").alias("leaf_us"))
    ranked = prefix(runs.withColumn("one", F.lit(1).cast("bigint")), "run", "one", "leaf", by=("key",))
    return numbered.join(ranked, ["key", "run"]).select(
        "key", "cell", "leaf", "dense", (F.col("cell") == F.col("first_cell")).alias("opens"), F.col("leaf_us").alias("first_us"))


def _entries(placed: DataFrame, span: int, levels: int) -> DataFrame:
    """``key, leaf, entry``: the event at which the chain enters each leaf; leaves that it leaps over have none."""
    entries = placed.where("leaf = 0").groupBy("key").agg(F.min("us").alias("entry")).select(
        "key", F.lit(0).cast("bigint").alias("leaf"), "entry")
    if not levels:
        return entries
    jumps = [materialize(_jumps(placed, span), "transaction-jumps-0")]
    for level in range(1, levels):
        jumps.append(materialize(_doubled(jumps[-1]), f"transaction-jumps-{level}"))
    for level in range(levels - 1, -1, -1):
        # where the chain enters a range of the level above, it enters the half that holds the event; from the first
        # half a jump may lead into the second
        half = F.shiftright("leaf", level)
        onward = (
            entries.withColumn("range", half).where("range % 2 = 0").drop("leaf")
            .join(jumps[level].drop("first"), ["key", "range", "entry"])
            .where(F.shiftright("exit_leaf", level) == F.col("range") + 1)
            .select("key", F.col("exit_leaf").alias("leaf"), F.col("exit").alias("entry"))
        )
        entries = materialize(entries.unionByName(onward), f"transaction-entries-{level}")
    return entries


def _jumps(placed: DataFrame, span: int) -> DataFrame:
    """``key, range, entry, first, exit, exit_leaf`` for each event at which a chain may enter a leaf (its range);
    ``first`` marks the leaf's first event, ``exit`` is null where the key ends."""
    def leave(group, table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table["us"].to_numpy())
        at = table["us"].to_numpy()[order]
        inside = int(table["opens"].to_numpy(zero_copy_only=False).sum())
        following = np.searchsorted(at, at + span, side="right")
        entries = np.arange(min(inside + 1, len(at)))
        place = entries.copy()
        while (moving := following[place] < len(at)).any():
            place = np.where(moving, following[place], place)
        return pa.table({
            "key": pa.array([group[0].as_py()] * len(entries), pa.string()),
            "range": pa.array([group[1].as_py()] * len(entries), pa.int64()),
            "entry": pa.array(at[entries], pa.int64()),
            "first": pa.array(entries == 0),
            "reach": pa.array(at[place] + span + 1, pa.int64()),
        })

    left = placed.where("not dense").select("key", "leaf", "us", "opens").groupBy("key", "leaf").applyInArrow(
        leave, "key string, range bigint, entry bigint, first boolean, reach bigint")
    dense = placed.where("dense").select(
        "key", F.col("leaf").alias("range"), F.col("us").alias("entry"), (F.col("us") == F.col("first_us")).alias("first"),
        (F.col("us") + span + 1).alias("reach"))
    leaving = materialize(left.unionByName(dense), "transaction-leaving")
    # the first entry at or behind each reach: the last one before it on the reversed axis
    here = F.struct(F.col("entry").alias("us"), F.col("range").alias("leaf"))
    none = F.lit(None).cast("struct<us: bigint, leaf: bigint>")
    points = leaving.select("key", F.col("entry").alias("at"), here.alias("here")).unionByName(
        leaving.select("key", F.col("reach").alias("at"), none.alias("here")))
    points = points.groupBy("key", (-F.col("at")).alias("back")).agg(F.max("here").alias("here"))
    behind = prefix(points, "back", "here", "behind", "last", level=3, by=("key",))
    landing = behind.select("key", (-F.col("back")).alias("reach"), F.coalesce("here", "behind").alias("landing"))
    return leaving.join(landing, ["key", "reach"]).select(
        "key", "range", "entry", "first", F.col("landing.us").alias("exit"), F.col("landing.leaf").alias("exit_leaf"))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Jumps over pairs of ranges from those over single ones.

    A pair is entered where its first half is, or at the first event of the second half.
    """
    odd = jumps.where("range % 2 = 1")
    second = odd.select("key", (F.col("range") - 1).alias("range"), F.col("entry").alias("exit"),
                        F.col("exit").alias("exit2"), F.col("exit_leaf").alias("leaf2"), F.lit(True).alias("lands"))
    both = jumps.where("range % 2 = 0").join(second, ["key", "range", "exit"], "left")
    composed = both.select(
        "key", "range", "entry", "first", F.when(F.col("lands"), F.col("exit2")).otherwise(F.col("exit")).alias("exit"),
        F.when(F.col("lands"), F.col("leaf2")).otherwise(F.col("exit_leaf")).alias("exit_leaf"))
    late = odd.where("first").withColumn("first", F.lit(False))
    return composed.unionByName(late).withColumn("range", F.shiftright("range", 1))


def _walk(placed: DataFrame, entries: DataFrame, span: int) -> DataFrame:
    """Parts of groups, one leaf each; those before a leaf's first start have no ``start_us`` yet."""
    def walk(group, table, entry):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table["us"].to_numpy())
        at, n = table["us"].to_numpy()[order], table["n"].to_numpy()[order]
        following = np.searchsorted(at, at + span, side="right")
        starts = []
        place = int(np.searchsorted(at, entry["entry"][0].as_py())) if len(entry) else len(at)
        while place < len(at):
            starts.append(place)
            place = int(following[place])
        firsts = np.array([0, *starts] if len(at) and (not starts or starts[0]) else starts, dtype=np.int64)
        own = pa.array(at[firsts], pa.int64(), mask=~np.isin(firsts, starts))
        ends = np.append(firsts[1:], len(at))[:len(firsts)] - 1
        return pa.table({
            "key": pa.array([group[0].as_py()] * len(firsts), pa.string()),
            "leaf": pa.array([group[1].as_py()] * len(firsts), pa.int64()),
            "start_us": own,
            "end_us": pa.array(at[ends], pa.int64()),
            "n": pa.array(np.add.reduceat(n, firsts) if len(firsts) else [], pa.int64()),
        })

    own = entries.select(F.col("key").alias("own_key"), F.col("leaf").alias("own_leaf"), "entry")
    gathered = (
        placed.where("not dense").select("key", "leaf", "us", "n").groupBy("key", "leaf")
        .cogroup(own.groupBy("own_key", "own_leaf")).applyInArrow(walk, PART)
    )
    # a dense leaf is one cell and so has one start at most
    summed = (
        placed.where("dense").join(entries, ["key", "leaf"], "left")
        .groupBy("key", "leaf", F.when(F.col("us") >= F.col("entry"), F.col("entry")).alias("start_us"))
        .agg(F.max("us").alias("end_us"), F.sum("n").alias("n"))
    )
    return gathered.unionByName(summed)


def _heads(parts: DataFrame) -> DataFrame:
    """Parts without a start get the last one of the leaves before."""
    last = parts.groupBy("key", "leaf").agg(F.max("start_us").alias("last_us"))
    before = prefix(last, "leaf", "last_us", "before_us", "last", by=("key",)).select("key", "leaf", "before_us")
    return parts.join(before, ["key", "leaf"]).withColumn("start_us", F.coalesce("start_us", "before_us"))
