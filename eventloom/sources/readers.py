"""Readers for exported search results and for the event table."""

from __future__ import annotations

import codecs
import logging
import re
from collections.abc import Iterator, Sequence
from contextlib import closing
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import relative_time
from eventloom.sources.json_pieces import event_lines


logger = logging.getLogger(__name__)


def _no_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


CHUNK_BYTES = 1 << 16


def _pieces(spark: SparkSession, path: str) -> Iterator[str]:
    """The text of the first file with content at the path, which may be a folder or glob, in pieces as they are asked for.

    Unpacked as Spark's readers do, by the codec of the file's name. A file that unpacks to nothing has no content.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    found = list(files.globStatus(target) or [])
    if not found:
        raise FileNotFoundError(path)
    while found:
        status = found.pop(0)
        if status.isDirectory():
            inner = [x for x in files.listStatus(status.getPath()) if x.getPath().getName()[0] not in "._"]
            found = sorted(inner, key=lambda x: x.getPath().getName()) + found
        elif status.getLen():
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(status.getPath())
            stream = files.open(status.getPath())
            try:
                if codec is not None:
                    stream = codec.createInputStream(stream)
                decoder, start = codecs.getincrementaldecoder("utf-8")("ignore"), True
                while raw := _read(jvm, stream):
                    text = decoder.decode(raw)
                    if start:
                        text = text.lstrip("\ufeff").lstrip()
                    if text:
                        start = False
                        yield text
            finally:
                stream.close()
            if not start:
                return


def _head(spark: SparkSession, path: str) -> str:
    with closing(_pieces(spark, path)) as pieces:
        return next(pieces, "")


def _read(jvm, stream) -> bytes:
    part = jvm.org.apache.commons.io.input.BoundedInputStream(stream, CHUNK_BYTES)
    return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(part))


IN_STRING = re.compile(r'["\\\n]')
TOKEN = re.compile(r'["{}\[\],:\n]|[^\s"{}\[\],:]+')


def _tokens(pieces: Iterator[str]) -> Iterator[str]:
    """Tokens of a JSON text and its line feeds. Of a string only the beginning is kept, so length costs no memory."""
    text, escaped = None, False  # text: the string that is open
    for piece in pieces:
        at = 0
        while at < len(piece):
            if escaped:
                at, escaped = at + 1, False
                continue
            m = (TOKEN if text is None else IN_STRING).search(piece, at)
            if text is not None and len(text) < 64:
                text += piece[at:m.end() if m else len(piece)][:64]
            if not m:
                break
            at, token = m.end(), m.group()
            if text is None and token == '"':
                text = token
            elif text is not None and token == "\\":
                escaped = True
            elif text is not None and token == '"':
                yield text
                text = None
            else:
                yield token


def _is_lines(pieces: Iterator[str]) -> bool:
    """Whether a text that begins with an object has one object per line.

    It has if the first object ends within its line and is no envelope, an envelope being an object whose own field
    ``results`` is a list that is empty or begins with an object. Reads as far as that takes, whatever the length.
    """
    depth, key, opened, ended = 0, None, False, False
    for token in _tokens(pieces):
        if depth == 0 and key is not None:  # behind the first object
            if token != "\n":
                return ended
            ended = True
            continue
        if token == "\n" or opened and token in ("{", "]"):
            return False
        opened = token == "[" and depth == 1 and key == '"results"'
        if token in ("{", "["):
            depth += 1
        elif token in ("}", "]"):
            depth -= 1
            if depth == 0:
                key = key or ""
        elif depth == 1 and token == ",":
            key = None
        elif depth == 1 and key is None:
            key = token
    return depth == 0 and key is not None


def _two_objects(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is read is a whole object and another object begins in the next line of that file."""
    text = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        F.input_file_name().alias("file"), F.json_object_keys(text).isNotNull().alias("whole"), text.startswith("{").alias("opens"))
    first = rows.head(2)  # two flags per line reach the driver, whatever the length of the lines
    return len(first) == 2 and first[0]["file"] == first[1]["file"] and first[0]["whole"] and first[1]["opens"]


def read_events_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     lines: bool = False) -> DataFrame:
    """Search results as JSON: an object with ``results``, a top-level list, or (``lines``) one object
    per line.

    Lines are splittable and the form to use for large inputs. ``schema`` (for instance from the
    schema catalogue) saves the inference pass. Where a field is a scalar in one event and a list
    in another, it is read as text. Envelopes and lists are cut into lines first, which are written in the scratch folder
    (see ``spark.checkpoint.dir`` in the README). Any other shape gives no events. Fields that differ only by case need
    ``spark.sql.caseSensitive``, which ``build_session`` sets; readers leave the session as it is.
    """
    reader = spark.read.option("multiLine", not lines)
    if lines:
        return (reader.schema(schema) if schema is not None else reader).json(path)
    head = _head(spark, path)
    # cut into events by many tasks; what is no such document, or not in UTF-8, is read whole by one
    cut = event_lines(spark, path, not head.startswith("[")) if head[:1] in ("[", "{") and "\0" not in head else None
    if cut is not None:
        found = spark.read if schema is None else spark.read.schema(schema)
        return found.json(cut)
    if head.startswith("["):
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if schema is not None:
        inner = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        reader = reader.schema(T.StructType([T.StructField("results", T.ArrayType(inner))]))
    found = reader.json(path)
    kind = found.schema["results"].dataType if "results" in found.columns else None
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        if not (isinstance(kind, T.ArrayType) or found.isEmpty()):
            logger.warning("%s is neither an envelope nor a list of events; it is read as no events", path)
        return _no_events(spark)
    return found.select(F.inline("results"))


def _typed(text: Column, kind: T.DataType) -> Column:
    """The value of a JSON text as ``kind``; null where it is of another shape, at any depth."""
    if isinstance(kind, T.StructType):
        def fields(given: Column) -> Column:
            return F.struct(*(_typed(F.element_at(given, f.name), f.dataType).alias(f.name) for f in kind.fields))

        # given as a list of one, so that the text is parsed once for all fields
        return F.when(_opens(text, "{"), F.get(F.transform(F.array(F.from_json(text, GIVEN)), fields), 0))
    if isinstance(kind, T.ArrayType):
        return F.when(_opens(text, "["), F.transform(
            F.from_json(text, "array<string>"), lambda x: _typed(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.when(_opens(text, "{"), F.transform_values(F.from_json(text, GIVEN), lambda _, x: _typed(x, kind.valueType)))
    return text.try_cast(kind)


def _fits(text: Column, kind: T.DataType) -> Column:
    """Whether ``_typed`` keeps everything of a JSON text."""
    if isinstance(kind, T.StructType):
        known = F.array(*(F.lit(f.name) for f in kind.fields)).cast("array<string>")

        def fits(given: Column) -> Column:
            inner = F.forall(F.map_keys(given), lambda k: F.array_contains(known, k))
            for f in kind.fields:
                inner = inner & _fits(F.element_at(given, f.name), f.dataType)
            return inner

        whole = _opens(text, "{") & F.forall(F.array(F.from_json(text, GIVEN)), fits) & ~_repeats(text)
    elif isinstance(kind, T.ArrayType):
        whole = _opens(text, "[") & F.forall(F.from_json(text, "array<string>"), lambda x: _fits(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        whole = _opens(text, "{") & ~_repeats(text) & F.forall(
            F.map_values(F.from_json(text, GIVEN)), lambda x: _fits(x, kind.valueType))
    else:
        whole = text.try_cast(kind).isNotNull()
    return text.isNull() | F.coalesce(whole, F.lit(False))


GIVEN = "map<string,string>"


def _opens(text: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(text), F.lit(mark))


def _repeats(text: Column) -> Column:
    """Whether an object names a field twice."""
    keys = F.json_object_keys(text)
    return F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))


def read_events_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line by a schema from the catalogue, without losing what has drifted since.

    A field that the schema does not know, or that holds anything its type cannot, at any depth, is kept whole in ``extra`` (a
    map of JSON texts); of a nested field the typed column then still has what fits, a plain one is null. A line that is
    no object, or names a field twice, is kept as ``extra['_line']``. Needs no inference pass and splits files; ``extra`` is
    null where nothing has drifted.
    """
    known = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    line = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", GIVEN).alias("given"))
    held = F.array_compact(F.array(*(
        F.when(_fits(F.element_at("given", f.name), f.dataType), F.lit(f.name)) for f in known.fields
    ))).cast("array<string>")
    drifted = F.map_filter("given", lambda k, v: ~F.array_contains(held, k))
    extra = F.when(F.col("given").isNull() | _repeats(F.col("value")), F.create_map(F.lit("_line"), "value")).when(
        F.size(drifted) > 0, drifted)
    return line.select(*(_typed(F.element_at("given", f.name), f.dataType).alias(f.name) for f in known.fields), extra.alias("extra"))


def read_events_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with a header; every column is text. Without line breaks in quoted fields pass
    ``multiline=False``, so that large files are split."""
    return (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline)
        .option("escape", '"').csv(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON (envelope, list, or one object per line) or CSV, told apart by how the first file begins, not by its name.

    Objects in two lines one after another are events, whatever fields they have; a single object is an envelope if its field
    ``results`` is a list of objects, else an event.
    """
    head = _head(spark, path)
    if head.startswith("{"):
        lines = _two_objects(spark, path)
        if not lines:
            with closing(_pieces(spark, path)) as pieces:
                lines = _is_lines(pieces)
        return read_events_json(spark, path, lines=lines)
    if head.startswith("["):
        return read_events_json(spark, path)
    return read_events_csv(spark, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON list or CSV by file extension, with typed columns and ``time`` as a timestamp."""
    if path.endswith(".json"):
        found = spark.read.option("multiLine", True).json(path)
    elif path.endswith(".csv"):
        found = spark.read.option("header", True).option("inferSchema", True).option(
            "multiLine", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported file type: {path} (expected .json or .csv)")
    if "time" in found.columns:
        if isinstance(found.schema["time"].dataType, T.StringType):
            found = found.withColumn("time", F.try_to_timestamp("time"))
        else:
            found = found.withColumn("time", F.col("time").cast("timestamp"))
    return found


def write_event_table(events: DataFrame, path: str, files: int | None = None, mode: str = "append",
                      indexed: Sequence[str] = ("host",), distinct: int = 100_000) -> None:
    """Event table partitioned by ``date``.

    The ``indexed`` columns get a Bloom filter per row group, sized for ``distinct`` values, so that a search for a few of their
    values skips the row groups that hold none, however the hosts are spread over time.

    Ranges of (date, sourcetype, time) rather than a hash of the date: a hot day is split over many
    tasks, and narrow time ranges per file let a time filter skip files and row groups. The last
    range key differs between equal rows, so that even one instant can be split.
    """
    order = ["date", "sourcetype", "time"] if "sourcetype" in events.columns else ["date", "time"]
    dated = events.withColumn("date", F.to_date("time")).withColumn("__spread", F.monotonically_increasing_id())
    keys = [*order, "__spread"]
    spread = dated.repartitionByRange(files, *keys) if files else dated.repartitionByRange(*keys)
    writer = spread.sortWithinPartitions(*order).drop("__spread").write.mode(mode).partitionBy("date")
    for name in indexed:
        if name in events.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    writer.parquet(path)


def scan_events(spark: SparkSession, path: str, now: datetime, earliest: str = "-24h", latest: str = "now",
                sourcetypes: Sequence[str] = (), hosts: Sequence[str] = ()) -> DataFrame:
    """Events of the table with ``earliest <= time < latest``.

    The same range on ``date`` prunes partitions; the other conditions are pushed to the scan, where statistics and, for
    hosts, Bloom filters of row groups are asked.
    """
    begin, end = relative_time(earliest, now), relative_time(latest, now)
    events = spark.read.parquet(path).where(
        (F.col("date") >= F.lit(begin.date())) & (F.col("date") <= F.lit(end.date()))
        & (F.col("time") >= F.lit(begin)) & (F.col("time") < F.lit(end))
    )
    if sourcetypes:
        events = events.where(F.col("sourcetype").isin(list(sourcetypes)))
    if hosts:
        events = events.where(F.col("host").isin(list(hosts)))
    return events.drop("date")
