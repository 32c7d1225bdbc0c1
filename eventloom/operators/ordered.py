"""Exact computations over a global time order, without ever ordering everything in one task.

Three ideas carry this module:

* A prefix over the whole time axis is computed in levels: rows inside a block, blocks inside a
  block of blocks, and so on. A block covers a fixed range of the key, so with one row per key
  no group exceeds ``2**BLOCK_BITS`` rows, however the events are spread; the last level is one
  group of all blocks that are left, one row per ``2**(BLOCK_BITS * (levels - 1))`` keys at most.
* Before anything is ordered, events collapse to one row per timestamp (or per time cell), with
  map-side combine. A hot instant, host or hour is a number by the time it is shuffled.
* Where single rows matter (rolling windows of n rows), Spark's sampled range sort balances
  partitions by row count; positions are then handed out on the written result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import floor_div
from eventloom.session import materialize

US = 1_000_000
BLOCK_BITS = 20
LEVELS = 2  # the seconds of the years 1 to 9999 then fill at most 3e5 blocks, 1e12 row numbers 1e6
KEY_LIMIT = 1 << 62
BLOCK_ROWS = 1 << 16


def prefix(df: DataFrame, key: str, value: str, out: str, how: str = "sum", level: int = LEVELS,
           bits: int = BLOCK_BITS, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the sum (or last non-null value) of ``value`` over all rows of smaller ``key``.

    ``key`` is a long from ``-KEY_LIMIT`` to below ``KEY_LIMIT`` (others raise an overflow), unique in ``df``; with
    ``by`` (columns without nulls) the prefix is taken, and the key unique, per combination of these.
    """
    block, subtotal, earlier = f"__block{level}", f"__total{level}", f"__earlier{level}"
    before = Window.partitionBy(*by, block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # the last level has no block but the whole range of keys, to which this shift gives the number 0
    number = F.shiftright(F.col(key), bits) if level > 1 else F.shiftright(F.col(key) + F.lit(KEY_LIMIT), 63)
    blocked = df.withColumn(block, number)
    inside = F.sum(value) if how == "sum" else F.last(value, ignorenulls=True)
    local = blocked.withColumn(out, inside.over(before))
    if level <= 1:
        return _default_zero(local, out, how).drop(block)
    if how == "sum":
        total = F.sum(value)
    else:
        total = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key)))
    blocks = blocked.groupBy(*by, block).agg(total.alias(subtotal))
    offsets = prefix(blocks, block, subtotal, earlier, how, level - 1, bits, by)
    joined = local.join(offsets.select(*by, block, earlier), [*by, block], "left")
    if how == "sum":
        combined = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col(earlier), F.lit(0))
    else:
        combined = F.coalesce(F.col(out), F.col(earlier))
    return joined.withColumn(out, combined).drop(block, earlier)


def _default_zero(df: DataFrame, out: str, how: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(0))) if how == "sum" else df


def near_bursts(timed: DataFrame, window_seconds: int, threshold: int) -> DataFrame:
    """Only those rows of ``timed`` (``us``, and ``n`` events each) that a window of ``threshold`` events can touch.

    On cells as wide as the window a window lies in two neighbouring cells, so their counts bound it.
    The counts come from one map-side combined pass over the time column. They are written, so Spark knows
    their size when it picks the join: a broadcast where cells are few, else a shuffle that may be split.
    """
    if window_seconds == 0:
        return timed
    width = window_seconds * US
    cell = floor_div(F.col("us"), width)
    counts = materialize(timed.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")), "cells")
    spread = counts.select("cell", "n", F.lit(0).cast("bigint").alias("next_n")).unionByName(
        counts.select((F.col("cell") - 1).alias("cell"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("next_n"))
    )
    needed = (
        spread.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("next_n").alias("next_n"))
        .where((F.col("n") > 0) & (F.col("n") + F.col("next_n") >= threshold))
        .select(F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
        .distinct()
    )
    needed = materialize(needed, "burst-cells")
    chosen = timed.withColumn("__cell", cell).join(needed, F.col("__cell") == needed["cell"], "left_semi")
    return chosen.drop("__cell")


def forward_counts(times: DataFrame, window_seconds: int, threshold: int) -> DataFrame:
    """Timestamps followed by at least ``threshold`` events within the window, with that count.

    ``times`` has one row per distinct ``us`` with its number of events ``n``. The window is
    closed on both sides and begins at the timestamp itself. Result: ``us, event_count``.

    Counts per whole second bound every window from above, so seconds that cannot qualify are
    dropped before any timestamp is ordered. What remains needs the order only inside single
    seconds (at most a million distinct timestamps): a window ending ``w`` seconds later has the
    same offset in its last second as in its first.
    """
    if window_seconds == 0:
        return times.where(F.col("n") >= threshold).select("us", F.col("n").alias("event_count"))
    times = times.withColumn("sec", floor_div(F.col("us"), US))
    seconds = times.groupBy("sec").agg(F.sum("n").alias("n"))
    heads = (
        _second_sums(seconds, window_seconds)
        .where(F.col("in_second") + F.col("between") + F.col("in_last") >= threshold)
        .select(F.col("sec").alias("head_sec"), (F.col("in_second") + F.col("between")).alias("from_start"))
    )
    span_us = window_seconds * US
    parts = times.select(
        F.explode(F.array(
            F.struct(F.col("sec").alias("head_sec"), F.col("us").alias("at"), F.lit(True).alias("is_head")),
            F.struct((F.col("sec") - window_seconds).alias("head_sec"), (F.col("us") - span_us).alias("at"),
                     F.lit(False).alias("is_head")),
        )).alias("part"),
        "n",
    ).select("part.*", "n").join(heads, "head_sec")
    # from the start of the first second: minus what lies before the head, plus what the window
    # reaches of its last second. Running sums only: frames open to the future cost a pass per row.
    so_far = Window.partitionBy("head_sec").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    moved = F.sum(F.when(F.col("is_head"), -F.col("n")).otherwise(F.col("n"))).over(so_far)
    counted = parts.select("at", "is_head", (F.col("from_start") + F.col("n") + moved).alias("event_count"))
    return counted.where("is_head").where(F.col("event_count") >= threshold).select(
        F.col("at").alias("us"), "event_count"
    )


def _second_sums(seconds: DataFrame, w: int) -> DataFrame:
    """Events per second (``in_second``), in the second ``w`` later (``in_last``), and ``between`` them.

    Blocks of seconds with the first ``w`` seconds of the next block. Every second puts markers where
    its window ends, and running counts at the markers give the sums.
    """
    size = max(w + 1, 1 << 14)
    offset = F.pmod(F.col("sec"), F.lit(size))
    block = floor_div(F.col("sec"), size)

    def point(block, at, kind: str, n):
        return F.struct(block.alias("block"), at.alias("at"), F.lit(kind).alias("kind"), n.alias("n"))

    none = F.lit(0).cast("bigint")
    own = [
        point(block, F.col("sec"), "own", F.col("n")),
        point(block, F.col("sec") + (w - 1), "before_last", none),
        point(block, F.col("sec") + w, "last", none),
    ]
    halo = [point(block - 1, F.col("sec"), "halo", F.col("n"))]
    points = seconds.select(
        "sec", F.explode(F.when(offset <= w, F.array(*own, *halo)).otherwise(F.array(*own))).alias("p")
    ).select("sec", "p.*")
    so_far = Window.partitionBy("block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    running = points.withColumn("running", F.sum("n").over(so_far))

    def at(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("running")))

    return (
        running.where(F.col("kind") != "halo")
        .groupBy("block", "sec")
        .agg(
            F.max("n").alias("in_second"),
            (at("before_last") - at("own")).alias("between"),
            (at("last") - at("before_last")).alias("in_last"),
        )
        .drop("block")
    )


def gap_sessions(cells: DataFrame, gap_us: int) -> DataFrame:
    """Number the sessions of a time axis cut into cells no wider than the allowed gap.

    ``cells`` has one row per ``cell`` with its ``first_us`` and ``last_us``. Two events of one
    cell always share a session and only neighbouring cells can be linked, so sessions follow
    from the cells alone. Adds ``session``.
    """
    own = cells.select("cell", "first_us", "last_us", F.lit(None).cast("bigint").alias("prev_us"))
    as_neighbour = cells.select(
        (F.col("cell") + 1).alias("cell"),
        F.lit(None).cast("bigint").alias("first_us"),
        F.lit(None).cast("bigint").alias("last_us"),
        F.col("last_us").alias("prev_us"),
    )
    linked = (
        own.unionByName(as_neighbour)
        .groupBy("cell")
        .agg(F.max("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
             F.max("prev_us").alias("prev_us"))
        .where(F.col("first_us").isNotNull())
        .withColumn(
            "opens",
            F.when(F.col("first_us") - F.col("prev_us") <= gap_us, F.lit(0)).otherwise(F.lit(1)).cast("bigint"),
        )
    )
    # cells as narrow as a microsecond need more levels than cells of a second or more
    levels = LEVELS if gap_us >= US else 3
    numbered = prefix(linked, "cell", "opens", "opened_before", level=levels)
    return numbered.withColumn("session", F.col("opened_before") + F.col("opens")).drop("opens", "opened_before", "prev_us")


def number_rows(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with ``idx``, their exact 0-based position in the global order, and the row count.

    The sort is Spark's sampled range sort, so partitions are even for any distribution of the
    order columns; a last key that differs between equal rows lets it also split copies. Positions are handed out on the written result: the count per partition and
    the rows then come from the very same partitioning, whatever is recomputed later.
    """
    placed = materialize(
        rows.withColumn("__spread", F.monotonically_increasing_id())
        .orderBy(*order, "__spread")
        .drop("__spread")
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__place", 33))
        .withColumn("__row", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__place"),
        "numbered",
    )
    # one row per sort partition: bounded by the shuffle partition count, not by the data
    sizes = sorted(placed.groupBy("__part").count().collect())
    spark = rows.sparkSession
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    lookup = spark.createDataFrame(offsets, "__part bigint, __offset bigint")
    numbered = (
        placed.join(F.broadcast(lookup), "__part")
        .withColumn("idx", F.col("__offset") + F.col("__row"))
        .drop("__part", "__row", "__offset")
    )
    return numbered, total


def with_halo(numbered: DataFrame, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut numbered rows into even blocks; each block also gets the ``halo`` rows before it.

    Adds ``block`` and ``own`` (false for the copied rows).
    """
    size = max(block_rows, halo)
    block = floor_div(F.col("idx"), size)
    is_tail = F.pmod(F.col("idx"), F.lit(size)) >= size - halo
    return (
        numbered.withColumn("home", block)
        .withColumn("block", F.explode(F.when(is_tail, F.array(block, block + 1)).otherwise(F.array(block))))
        .withColumn("own", F.col("block") == F.col("home"))
        .drop("home")
    )


def group_numbers(rows: DataFrame, key: str, opens: Column, out: str) -> DataFrame:
    """Running number of the group that ``opens`` starts, over rows with a unique long ``key``."""
    marked = rows.withColumn("__opens", opens.cast("bigint"))
    counted = prefix(marked, key, "__opens", "__before")
    return counted.withColumn(out, F.col("__before") + F.col("__opens")).drop("__opens", "__before")
