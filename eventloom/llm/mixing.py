"""Mixing sources to target weights: hash-random order, prefix sums of sizes, an exact cut per source.

Every document gets a key, the MD5 of its id, so the order within a source is random but the same in each
run. Because keys are uniform, equal ranges of the key space hold nearly equal numbers of rows; ranges of a
source are sorted by themselves and their totals give the offsets, so a source with a third of all rows is
spread over as many tasks as it has ranges. The prefix sum is needed only to find the one document at which
a source's budget ends. That cut (one row per source) is then compared with each document's key, so texts
are never moved.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, the
last; null ids count as one id, before all others. Rows alike in id and size are cut evenly among each other (a
remainder smaller than their number is left untaken). An empty table gives an empty result. Columns that are
not named here are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.frames import ROWS_PER_TASK, n_words, pick, place, positional
from eventloom.session import gathered, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Mean number of rows that one range of a source's key space holds.
RANGE_ROWS = 50_000
#: Hex digits of the key that number its range.
RANGE_DIGITS = 6


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets by source: ``source, source_size, n_rows, target, epochs, rest``.

    ``sizes`` has one row per source (``source, source_size, n_rows``); the windows below see only these rows.
    A share is ``weight`` parts of all words but at most ``max_epochs`` times the source. Sources sorted by
    size against weight are capped from the smallest on: the first one that stays below its cap, when all
    before it are capped, fixes the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    unit = lcm(*weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    placed = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("fill", F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("bigint"))
    )
    order = Window.orderBy("fill", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * max_epochs
    none = F.lit(0).cast("bigint")
    level = F.col("left_words").cast("double") * F.col("weight") / F.col("left_weight")
    levelled = (
        placed
        .withColumn("left_words", F.sum("source_size").over(everything) - max_epochs * F.coalesce(
            F.sum("source_size").over(before), none))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none))
        .withColumn("open", F.when(level <= cap, F.struct("fill", "place", "left_words", "left_weight")))
        .withColumn("first", F.min("open").over(everything))
        .withColumn("target", F.when(
            F.struct("fill", "place") < F.struct("first.fill", "first.place"), cap.cast("double")
        ).otherwise(F.col("first.left_words").cast("double") * F.col("weight") / F.col("first.left_weight")))
    )
    budget = F.floor("target").cast("bigint")
    some = F.greatest(F.col("source_size"), F.lit(1))
    return levelled.select(
        "source", "source_size", "n_rows", "target", F.floor(budget / some).cast("bigint").alias("epochs"),
        (budget - F.floor(budget / some) * some).alias("rest"))


def cuts(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
         max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per source: its target, its whole epochs, and where the last, partial one ends.

    ``source, source_size, target, epochs, cut_at (key, id, size), cut_words``: rows of smaller key are taken once
    more, rows at ``cut_at`` to ``cut_words`` words each; no cut where the epochs meet the budget.
    """
    named = pick(docs, "doc_id", "text", "source")
    n_docs = docs.count()
    rows = (
        named.select("source", _key(F.col("doc_id")).alias("key"), _id(F.col("doc_id")).alias("id"),
                     (n_words(F.col("text")) if size is None else size).alias("size"))
        .groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = materialize(gathered(rows, n_docs, ROWS_PER_TASK), "mix-rows")
    sizes = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    wanted = materialize(targets(sizes, weights, max_epochs), "mix-targets")
    ranges = F.greatest(F.lit(1), F.least(F.lit(16 ** RANGE_DIGITS), F.ceil(F.col("n_rows") / range_rows)))
    number = F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("bigint")
    ranged = rows.join(wanted.select(F.col("source").alias("of"), "n_rows", "rest"), F.col("source").eqNullSafe(F.col("of")))
    ranged = ranged.where(F.col("rest") > 0).select(
        "source", "key", "id", "size", "n", "rest", F.floor(number * ranges / 16 ** RANGE_DIGITS).alias("range"))
    total = F.col("size") * F.col("n")
    none = F.lit(0).cast("bigint")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("source", "range").agg(F.sum(total).alias("words"), F.first("rest").alias("rest"))
    #: only the range in which the budget ends is sorted
    ending = (
        totals.withColumn("offset", F.coalesce(F.sum("words").over(earlier), none))
        .where((F.col("offset") < F.col("rest")) & (F.col("rest") <= F.col("offset") + F.col("words")))
        .select(F.col("source").alias("end_source"), F.col("range").alias("end_range"), "offset")
    )
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        ranged.join(ending, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("range") == F.col("end_range")))
        .withColumn("before", F.col("offset") + F.coalesce(F.sum(total).over(inside), none))
        .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + total))
        .select(F.col("source").alias("cut_source"), F.struct("key", "id", "size").alias("cut_at"),
                F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("bigint").alias("cut_words"))
    )
    joined = wanted.join(last, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    found = joined.select("source", "source_size", "target", "epochs", "cut_at", "cut_words")
    return materialize(gathered(found, n_docs, ROWS_PER_TASK), "mix-cuts")


def _partial(key: Column, ident: Column, size: Column) -> Column:
    """Words that the last, partial epoch takes of a row."""
    own = F.struct(key.alias("key"), ident.alias("id"), size.alias("size"))
    return F.when(F.col("cut_at").isNull(), 0).when(own < F.col("cut_at"), size).when(
        own == F.col("cut_at"), F.col("cut_words")).otherwise(0).cast("bigint")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id, text, source``)."""
    plan = cuts(docs, **how).withColumnRenamed("source", "of")
    sized = pick(docs, "doc_id", "text", "source").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    part = _partial(_key(F.col("doc_id")), _id(F.col("doc_id")), F.col("size"))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each whole epoch of a document, and the one
    document at which a source's budget ends cut after its last word taken. Sizes of texts are those of ``mix``."""
    plan = cuts(docs, **how)
    names, row = docs.columns, positional(docs)
    doc_id, text, source = (F.col(place(docs, x)) for x in ("doc_id", "text", "source"))
    size = n_words(text)
    joined = row.withColumn("__size", size).join(plan, source.eqNullSafe(F.col("source")))
    part = _partial(_key(doc_id), _id(doc_id), F.col("__size"))
    # whole copies, then the partial one
    lots = F.array_append(
        F.array_repeat(F.col("__size"), F.col("epochs").cast("int")), F.col("__part"))
    empty = F.col("__size") == 0  # nothing to count: such a row stays once
    copies = F.when(empty, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(lots, lambda x: x > 0))
    taken = joined.withColumn("__part", part).withColumn("__words", F.explode(copies))
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    leading = F.array_join(F.slice(pieces, F.lit(1), F.col("__words").cast("int")), "")
    cut = F.when(F.col("__words") < F.col("__size"), leading).otherwise(text)
    out = []
    for i, name in enumerate(names):
        column = F.col(f"__c{i}")
        if f"__c{i}" == place(docs, "text"):
            column = cut
        out.append(column.alias(name))
    return taken.select(*out)
