"""Cross-site boilerplate: lines that many distinct sites carry are removed everywhere but where they come first.

Each line hash gets a HyperLogLog sketch of its sites. Sketches are built per task and merged by aggregation, so a
line that a third of all documents carry is a few small rows by the time it is shuffled. Where the estimate lies
clearly above the threshold, the line is boilerplate, clearly below it is not; what lies within three standard errors
of it is counted exactly (distinct pairs of line and site, again combined before the shuffle). Joins are with
written tables, so Spark broadcasts the list of lines only where its size allows and otherwise splits hot keys.

A line is what stands between line feeds, without white space at both ends; lines are compared by 64-bit hash. The
first place is the smallest (document id, text hash, line number), so an id that occurs once keeps exactly one.

Defined cases: a null text stays null, lines without content are never removed; a null source and an empty one are a site each;
null ids come first; rows alike in id and text are treated alike; a text of which nothing is left becomes empty, the row stays;
other columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import ROWS_PER_TASK, pick, place, positional
from eventloom.session import gathered, materialize

MIN_SITES = 5
#: Log2 of a sketch's registers; the relative standard error is 1.04 / sqrt(registers).
LOG_REGISTERS = 10
BLANK = " \t\r\x0b\x0c"
#: What begins a site's text, as sketches leave out empty strings, and what stands for a null source.
SITE, NO_SITE = "s", "none"


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """``id, version, site, at, line``: the hash of each line with content, and where it stands."""
    named = pick(docs, "doc_id", "text", "source").where(F.col("text").isNotNull())
    each = named.select(
        _id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("version"),
        F.coalesce(F.concat(F.lit(SITE), F.col("source").cast("string")), F.lit(NO_SITE)).alias("site"),
        F.posexplode(_split(F.col("text"))).alias("at", "raw"))
    trimmed = F.btrim("raw", F.lit(BLANK))
    return each.where(trimmed != "").select("id", "version", "site", "at", F.xxhash64(trimmed).alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """``line, first``: hashes of lines on at least ``min_sites`` distinct sites, with the place of the first."""
    error = 3 * 1.04 / math.sqrt(1 << log_registers) * min_sites
    low, high = min_sites - max(0.5, error), min_sites + max(0.5, error)
    spread = lines(docs).groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(log_registers)).alias("sites"), F.min(F.struct("id", "version", "at")).alias("first"))
    n = docs.count()
    wide = spread.select("line", "first", F.hll_sketch_estimate("sites").alias("about")).where(F.col("about") >= low)
    wide = materialize(gathered(wide, n, ROWS_PER_TASK), "wide-lines")
    near = wide.where(F.col("about") <= high)
    exact = (
        lines(docs).join(near.select("line"), "line", "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    )
    found = wide.where(F.col("about") > high).unionByName(near.join(exact.select("line"), "line", "left_semi"))
    return materialize(gathered(found.select("line", "first"), n, ROWS_PER_TASK), "boilerplate")


def removals(docs: DataFrame, **how) -> DataFrame:
    """``gone_id, gone_version, gone``: the numbers of the lines that a document loses."""
    listed = boilerplate(docs, **how)
    later = lines(docs).join(listed, "line").where(F.struct("id", "version", "at") != F.col("first"))
    return later.groupBy(F.col("id").alias("gone_id"), F.col("version").alias("gone_version")).agg(
        F.collect_set("at").alias("gone"))


def without_boilerplate(docs: DataFrame, counts: bool = False, **how) -> DataFrame:
    """``docs`` with the lines removed, all columns kept; with ``counts`` also ``n_lines`` and ``n_removed``."""
    names, row = docs.columns, positional(docs)
    text = F.col(place(docs, "text"))
    gone = materialize(gathered(removals(docs, **how), docs.count(), ROWS_PER_TASK), "line-removals")
    version = F.xxhash64(text)
    joined = row.join(gone, (_id(F.col(place(docs, "doc_id"))) == F.col("gone_id")) & (version == F.col("gone_version")), "left")
    parts = _split(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(rest)
    out = [(cleaned if f"__c{i}" == place(docs, "text") else F.col(f"__c{i}")).alias(n) for i, n in enumerate(names)]
    if counts:
        full = F.filter(F.coalesce(parts, F.array()), lambda x: F.btrim(x, F.lit(BLANK)) != "")
        out += [F.size(full).cast("bigint").alias("n_lines"),
                F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed")]
    return joined.select(*out)
