"""Packing along a space-filling curve: neighbours in content share sequences, and only the last one needs padding.

1. Each text is tokenised once. Its ids, hashed to signed buckets and summed, make a document vector, which a fixed
   random matrix projects to a few dimensions; the cell's position on a Hilbert curve is the document's key. Ids
   are written to the shared folder.
2. The narrow rows (key, id, length) are range-sorted, which is even for any distribution since ties are split, and
   written. Totals per sorted part give each part's offset, a running sum inside the part each document's.
3. Offsets go back to the ids by row number. A document is cut wherever a sequence of 2048 ends.

Defined cases: null and empty texts consist of the closing id alone; repeated rows are packed as often as they occur;
null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.frames import ROWS_PER_TASK, pick, slices
from eventloom.llm.tokens import RANKS, TOKENIZER, Encoder
from eventloom.session import gathered, materialize, scratch_root

LENGTH = 2048
END_ID = 1
BUCKETS = 512
DIMENSIONS = 3
BITS = 16
SEED = 20_240_229
#: Projected values beyond this many standard deviations share the outermost cell.
REACH = 4.0
ENCODE_BYTES = 4 << 20


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned cell coordinates (``bits`` bits each).

    Skilling's transform: undo the rotations and reflections from the highest bit down, Gray-encode, and
    interleave the bits of the axes.
    """
    axes = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(len(axes)):
            set_ = (axes[d] & high) != 0
            swapped = np.where(set_, np.uint64(0), (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swapped)
            if d:
                axes[d] = axes[d] ^ swapped
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] & np.uint64(1 << b)) != 0, turn ^ np.uint64((1 << b) - 1), turn)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((buckets, dimensions))


def curve_keys(ids: np.ndarray, places: np.ndarray, matrix: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve key of each document from its hashed and projected bag of ids (an empty one has the zero vector)."""
    n, buckets = len(places) - 1, len(matrix)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(40)) % np.uint64(buckets)
    cell = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(places)) + bucket.astype(np.int64)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(63)) & np.uint64(1)).astype(np.float64)
    vectors = np.bincount(cell, weights=sign, minlength=n * buckets).reshape(n, buckets)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    flat = (vectors / np.where(norm > 0, norm, 1.0)) @ matrix
    cells = np.clip((flat + REACH) / (2 * REACH), 0, 1) * ((1 << bits) - 1)
    return hilbert_key(np.rint(cells).astype(np.uint64), bits)


def _encode(tokenizer: str, ranks: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, matrix = Encoder(tokenizer, ranks), projection()
        for whole in batches:
            for batch in slices(whole, limit=ENCODE_BYTES):
                ids, places = encoder.encode(batch.column("text"))
                keys = curve_keys(ids, places, matrix)
                # small ids take two bytes: half the size on disk and in the shuffle
                narrow = ids.astype("<u2") if len(ids) == 0 or ids.max() < 1 << 16 else ids.astype("<u4")
                end = np.array([end_id], narrow.dtype).tobytes()
                raw = [narrow[a:b].tobytes() + end for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(places) + 1), pa.array(keys),
                     pa.array(np.full(len(raw), narrow.itemsize, np.int32)), pa.array(raw, pa.binary())],
                    ["doc_id", "doc_tokens", "curve_key", "width", "ids"])
    return run


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """``row, doc_id, doc_tokens, curve_key, width, ids`` of every document, written to the shared folder."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _encode(tokenizer, ranks, end_id), "doc_id bigint, doc_tokens bigint, curve_key bigint, width int, ids binary")
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/packing-ids-{uuid.uuid4().hex}"
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def offsets(rows: DataFrame) -> DataFrame:
    """``row, at``: how many ids lie before the document along the curve."""
    order = ("curve_key", "doc_id", "row")
    placed = (
        rows.select("row", "doc_id", "doc_tokens", "curve_key").orderBy(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .select("row", "doc_tokens", "place", F.shiftright("place", 33).alias("part"))
    )
    placed = materialize(gathered(placed, rows.count(), ROWS_PER_TASK), "packing-order")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    # one row per sorted part, of which there are as many as shuffle partitions
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), none).alias("start"))
    inside = placed.withColumn("inside", F.coalesce(F.sum("doc_tokens").over(before), none))
    return inside.join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("inside")).alias("at"))


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                out: list[list] = [[] for _ in range(7)]
                columns = (batch.column(i).to_pylist() for i in range(4))
                for (doc, at, tokens, width), raw in zip(zip(*columns), batch.column("ids")):
                    ids = np.frombuffer(raw.as_buffer(), "<u2" if width == 2 else "<u4").astype("<u4")
                    start = 0
                    while start < tokens:
                        sequence, offset = divmod(at + start, length)
                        end = min(tokens, start + length - offset)
                        piece = (doc, start, end - start, zlib.crc32(ids[start:end]), tokens, sequence, offset)
                        for column, value in zip(out, piece):
                            column.append(value)
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], [x.split()[0] for x in PIECES.split(", ")])
    return run


def pack(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """One row per piece of a document: where it starts there, and its sequence and offset in it."""
    rows = encoded(docs, **how)
    joined = rows.join(offsets(rows), "row").select("doc_id", "at", "doc_tokens", "width", "ids")
    return joined.mapInArrow(_cut(length), PIECES)
