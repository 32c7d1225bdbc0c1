"""Events of JSON documents of any size: a document is cut at closing braces, and nothing holds it whole.

The pieces between braces are numbered and dealt to runs of a bounded number of pieces. What a piece means depends on whether it
begins inside a string and how deep; both are running sums, taken inside each run for either case and then over the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.session import materialize, scratch_path

RUN_BITS = 14
RUN = ["file", "block", "run"]
ARRAY = r'"results"\s*:\s*\[\s*'


def _brackets(text: Column) -> Column:
    """The brackets outside strings of a text without escapes."""
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|\z)', ""), r"[^\[\]{]+", "")


def _rise(brackets: Column) -> Column:
    return 2 * F.length(F.replace(brackets, F.lit("]"), F.lit(""))) - F.length(brackets)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces up to a closing brace with their places, quotes, and brackets if they begin outside (0) or inside (1) a string."""
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    lead = F.regexp_extract(F.col("plain"), r"(?s)^(.*?)" + ARRAY + r"\{", 1)
    first = F.col("plain").rlike(ARRAY + r"\{")
    marked = text.withColumn("run", F.shiftright("at", RUN_BITS)).withColumn("plain", plain).select(
        *RUN, "at", "value",
        ((F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))) % 2).alias("odd"),
        _brackets(F.col("plain")).alias("b0"), _brackets(F.concat(F.lit('"'), "plain")).alias("b1"),
        F.when(first, _rise(_brackets(lead))).alias("lead0"),
        F.when(first, _rise(_brackets(F.concat(F.lit('"'), lead)))).alias("lead1"),
    )
    before = Window.partitionBy(*RUN).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)

    def rise(start: int) -> Column:
        """How much deeper a piece ends, its brace included, in a run that begins outside or inside a string."""
        state = (F.col("inside") + start) % 2
        brace = F.when((state + F.col("odd")) % 2 == 0, 1).otherwise(0)
        return _rise(F.when(state == 0, F.col("b0")).otherwise(F.col("b1"))) - brace

    stepped = inside.withColumn("rise0", rise(0)).withColumn("rise1", rise(1))
    return stepped.select("*", *(F.coalesce(F.sum(f"rise{i}").over(before), F.lit(0)).alias(f"above{i}") for i in (0, 1)))


def _run_starts(pieces: DataFrame) -> DataFrame:
    """Per run whether it begins inside a string, how deep, and how deep it ends."""
    totals = pieces.groupBy(*RUN).agg(F.sum("odd").alias("odd"), F.sum("rise0").alias("rise0"), F.sum("rise1").alias("rise1"))
    before = Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    quoted = totals.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    quoted = quoted.withColumn("rise", F.when(F.col("quoted") == 0, F.col("rise0")).otherwise(F.col("rise1")))
    return quoted.withColumn("depth", F.coalesce(F.sum("rise").over(before), F.lit(0))).select(
        *RUN, "quoted", "depth", (F.col("depth") + F.col("rise")).alias("end"), ((F.col("quoted") + F.col("odd")) % 2).alias("open"))


def event_lines(spark: SparkSession, path: str, envelope: bool) -> str | None:
    """Writes the events of lists, or of the lists ``results`` of envelopes, one per line, and gives the path of the lines.

    None if anything at the path is not a whole document of that form whose list holds objects only.
    """
    if spark.read.text(path).columns != ["value"]:  # columns of folder names
        return None
    pieces = materialize(_pieces(spark, path), "json-pieces")
    starts = materialize(_run_starts(pieces), "json-runs")
    last = starts.groupBy("file").agg(F.max_by(F.struct("end", "open"), F.struct("block", "run")).alias("last"))
    if not last.where(~F.col("last.end").isin(0, -1) | (F.col("last.open") != 0)).isEmpty():
        return None

    def either(name: str, state: str) -> Column:
        return F.when(F.col(state) == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = pieces.join(starts.select(*RUN, "quoted", "depth"), RUN).withColumn(
        "state", (F.col("inside") + F.col("quoted")) % 2).select(
        *RUN, F.struct("block", "at").alias("place"), "value", either("b", "state").alias("brackets"),
        either("lead", "state").alias("lead"), (F.col("depth") + either("above", "quoted")).alias("depth"))
    if envelope:
        opening = placed.where(F.col("depth") + F.col("lead") == 1).groupBy("file").agg(F.min("place").alias("first"))
        opening = materialize(opening, "json-lists")
        closing = placed.where((F.col("depth") == 2) & F.startswith("brackets", F.lit("]"))).join(opening, "file").where(
            F.col("place") > F.col("first")).groupBy("file").agg(
            F.min("place").alias("end"), F.min_by(F.col("value").rlike(r"^\s*\]"), "place").alias("whole"))
        lists = materialize(opening.join(closing, "file"), "json-lists")
        n_whole = lists.where("whole").count()
        if n_whole == 0 or n_whole < last.count():
            return None
        held = placed.join(lists, "file").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("end")))
        first, base = F.col("place") == F.col("first"), 2
    else:
        tail = (F.col("depth") <= 1) & ~F.contains("brackets", F.lit("{"))
        held, first, base = placed.where(~tail), F.col("depth") == 0, 1
        ends = placed.where(tail & ~F.col("value").rlike(r"^\ufeff?\s*(\[\s*)?\]?\s*$"))
        if not ends.isEmpty():
            return None
    opens = first | (F.col("depth") == base)
    before_first = r"(?s)^.*" + ARRAY + r"$" if envelope else r"^\ufeff?\s*\[\s*$"
    begin = F.when(first & F.lit(envelope), F.regexp_instr("value", F.lit(ARRAY + r"\{")) + F.length(
        F.regexp_substr("value", F.lit(ARRAY + r"\{"))) - 1).otherwise(F.instr("value", "{"))
    held = held.withColumn("begin", F.when(opens, begin)).withColumn("odd", opens & ~F.when(
        F.col("begin") < 1, False).when(first, F.expr("left(value, begin - 1)").rlike(before_first)).otherwise(
        F.expr("left(value, begin - 1)").rlike(r"^\s*,\s*$")))
    held = held.select(*RUN, "place", "odd", F.when(opens, F.col("place")).alias("opened"),
                       F.when(opens, F.expr("substr(value, begin)")).otherwise(F.col("value")).alias("part"))
    carried = held.groupBy(*RUN).agg(F.max("opened").alias("carried")).withColumn("carried", F.max("carried").over(
        Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)))
    so_far = Window.partitionBy(*RUN).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    events = (
        held.withColumn("opened", F.max("opened").over(so_far)).join(carried, RUN)
        .groupBy("file", F.coalesce("opened", "carried").alias("event"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"), F.max("odd").alias("odd"))
        .select("file", "event", "odd", F.concat(F.array_join("parts.part", "}"), F.lit("}")).alias("line"))
    )
    seen, lines = Observation(), scratch_path(spark, "json-lines")
    bad = F.count_if(F.col("odd") | F.json_object_keys("line").isNull())
    (events.observe(seen, bad.alias("bad"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("file", "event")
     .select(F.regexp_replace("line", r"[\r\n]+", " ")).write.text(lines))
    return lines if seen.get["n"] and not seen.get["bad"] else None
