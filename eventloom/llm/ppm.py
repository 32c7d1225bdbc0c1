"""Code length of texts by prediction by partial matching, learned from a whole corpus.

A text is its bytes with A-Z in lower case and an end symbol. A byte's probability depends on the ``ORDER`` bytes before it: the
longest context known to the trie predicts it, or gives an escape and passes to the next shorter one, in which the symbols of
the longer one are excluded; below the empty context the remaining symbols are equally likely. Escapes are
estimated from the number of different symbols in a context (half a count each).

The trie is kept as tables, one per depth: (context and symbol as one number, count). Nothing of it is ever gathered in
one place, and no context is pruned:

1. Documents are dealt into slices of ``SLICE`` bytes (one longer text makes its own). A slice lists its distinct grams
   (context and symbol) and words once, with their counts in training documents, in packs by a hash of the gram's first
   bytes or of the word. Packs are written beside the texts.
2. Packs are shuffled by bucket and their counts summed; each shorter order is the sum of the longer one. A symbol of a context is a symbol of all its
   suffixes, so exclusion needs three sums per context: all counts, the number of symbols, and the counts
   that these symbols have in the next shorter context.
3. Every gram that occurs gets its log probability once. Grams seen in training are answered by the longest context; only the others
   descend, one pair of joins per order.
4. The packs meet the values of their bucket and return to their slice, where the texts meet them. A frequent gram is one entry
   per slice, whatever its number of occurrences; a bucket with more than ``GROUP`` entries is split by slice.

Defined cases: a null text counts as empty and holds the end only; a null id hashes as empty text; repeated rows are scored alike and
count as often as they occur; extra columns are ignored; without training documents all symbols are equally likely and
the base score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import packs
from eventloom.llm.frames import pick, slices
from eventloom.llm.words import split
from eventloom.session import materialize

#: Bytes of context. A gram, one byte longer, must fit a number.
ORDER = 5
#: Bytes that no UTF-8 text holds: in front of a text as context, and behind it as its last symbol.
START, END = 0xFF, 0xFE
SYMBOLS = 255
SLICE = 16 << 20
BLOCK = 2 << 20
CHUNK = 1 << 16
#: Entries of packs that one task gathers at most before it sums them up, or answers them.
GROUP = 8 << 20
#: Bits of a gram behind the bytes that choose its bucket: neighbours in order stay together.
LOW_BITS = 24

DEALT = ("slice bigint, bucket int, entries bigint, doc_id bigint, held_out boolean, text string, grams binary, "
         "counts binary, words binary, word_counts binary")
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and of the end of each text, and which text each belongs to."""
    padded = pc.binary_join_element_wise(bytes([START]) * order, texts.cast(pa.binary()), bytes([END]), b"")
    ends = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset:padded.offset + len(padded) + 1]
    raw = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    keys = np.zeros(max(len(raw) - order, 0), np.int64)
    for i in range(order + 1):
        keys <<= 8
        keys |= raw[i:i + len(keys)]
    # each text starts with as many marks as a context is long, so no gram reaches into the text before
    keys = keys[raw[order:] != START]
    return keys, np.repeat(np.arange(len(padded)), np.diff(ends) - order)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.add.reduceat(count, first) if len(first) else count[:0]


def _counted(tables: list[pa.Table]) -> pa.Table:
    """Distinct words with the sums of their counts."""
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _chunks(column: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(column), CHUNK):
        yield column.slice(at, CHUNK)


class Slice:
    """What the texts of one slice hold, gathered block by block."""

    def __init__(self, order: int):
        self.order, self.bytes, self.distinct = order, 0, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: list[pa.Table] = []

    def add(self, texts: pa.Array, train: np.ndarray) -> None:
        keys, doc = grams(texts, self.order)
        for own, learned in ((keys[train[doc]], True), (keys[~train[doc]], False)):
            distinct, counts = np.unique(own, return_counts=True)
            self.keys.append(distinct)
            self.counts.append(counts if learned else np.zeros_like(counts))
        places, codes, words = split(texts)
        learned = np.bincount(codes, weights=np.repeat(train, np.diff(places)), minlength=len(words))
        # the empty word stands for the end of a text
        self.words.append(pa.table({"word": pa.array([*words, ""], pa.string()),
                                    "n": pa.array(np.append(learned, train.sum()).astype(np.int64))}))
        self.bytes += len(keys)
        # what was gathered is summed up whenever it has doubled
        if sum(map(len, self.keys)) > 2 * self.distinct + CHUNK:
            self.keys, self.counts = ([x] for x in _summed(self.keys, self.counts))
            self.words = [_counted(self.words)]
            self.distinct = len(self.keys[0])

    def packed(self, number: int, buckets: int) -> pa.RecordBatch:
        keys, counts = _summed(self.keys, self.counts)
        bucket = (keys >> LOW_BITS) % buckets
        order = np.argsort(bucket, kind="stable")
        keys, counts = keys[order], counts[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        table = _counted(self.words)
        hashed = np.concatenate([np.fromiter((zlib.crc32(w.encode()) % buckets for w in chunk.to_pylist()), np.int64, len(chunk))
                                 for chunk in _chunks(table.column("word").combine_chunks())])
        order = np.argsort(hashed, kind="stable")
        table = table.take(pa.array(order))
        words, word_counts = table.column("word").combine_chunks(), table.column("n").to_numpy()
        word_ends = np.searchsorted(hashed[order], np.arange(buckets + 1))
        bounds, word_bounds = (list(zip(x.tolist(), x[1:].tolist())) for x in (ends, word_ends))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(buckets, number)), pa.array(np.arange(buckets, dtype=np.int32)),
             pa.array(np.diff(ends) + np.diff(word_ends)), pa.nulls(buckets, pa.int64()), pa.nulls(buckets, pa.bool_()),
             pa.nulls(buckets, pa.string()), *(pa.array(column, pa.binary()) for column in (
                 [packs.ascending(keys[a:b]) for a, b in bounds], [packs.numbers(counts[a:b]) for a, b in bounds],
                 [packs.words(words[a:b].to_pylist()) for a, b in word_bounds],
                 [packs.numbers(word_counts[a:b]) for a, b in word_bounds]))], NAMES)
        return batch.filter(pc.greater(batch.column("entries"), 0))


NAMES = [x.split()[0] for x in DEALT.split(", ")]


def _deal(order: int, slice_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        current = Slice(order)
        for whole in batches:
            for batch in slices(whole, limit=min(BLOCK, slice_bytes)):
                texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
                current.add(texts, ~batch.column("held_out").to_numpy(zero_copy_only=False))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), batch.column("doc_id"),
                     batch.column("held_out"), texts, *(pa.nulls(n, pa.binary()) for _ in range(4))], NAMES)
                if current.bytes >= slice_bytes:
                    yield current.packed(number, buckets)
                    number, current = number + 1, Slice(order)
                    pa.default_memory_pool().release_unused()
        if current.bytes:
            yield current.packed(number, buckets)
    return run


def dealt(docs: DataFrame, order: int = ORDER, slice_bytes: int = SLICE, buckets: int | None = None) -> DataFrame:
    """Rows of texts (without a bucket) and packs of grams and words, by slice; written to the shared folder."""
    buckets = buckets or _buckets(docs)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    rows = rows.select("doc_id", "text", (~training(F.col("doc_id"))).alias("held_out"))
    return materialize(rows.mapInArrow(_deal(order, slice_bytes, buckets), DEALT), "ppm-slices", compression="zstd")


def _buckets(docs: DataFrame) -> int:
    """As many as the session's shuffles have partitions, which are chosen by the size of the input."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of packs that come one after another, at most ``GROUP`` entries at a time."""
    keys, counts, words, held = [], [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        key, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.string()), pa.array(n)], ["key", "word", "n"])
        table = _counted(words)
        yield from table.add_column(0, "key", pa.nulls(len(table), pa.int64())).to_batches()

    for batch in batches:
        for grams, n, word, word_n in zip(*(batch.column(c).to_pylist() for c in ("grams", "counts", "words", "word_counts"))):
            keys.append(packs.read_ascending(grams))
            counts.append(packs.read_numbers(n))
            words.append(pa.table({"word": packs.read_words(word), "n": packs.read_numbers(word_n)}))
            held += len(keys[-1]) + words[-1].num_rows
            if held > GROUP:
                yield from out()
                keys, counts, words, held = [], [], [], 0
    if keys:
        yield from out()


def _suffix(key: Column, order: int) -> Column:
    """The gram of a shorter order: the last bytes of a longer one."""
    return key.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def _context(key: Column) -> Column:
    return F.shiftright(key, 8)


def trie(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Grams with their counts (``key, n``) for each order from 0 on; ``counts`` has the longest."""
    levels = [materialize(counts.where("n > 0"), f"ppm-order-{order}")]
    for k in range(order - 1, -1, -1):
        shorter = levels[0].groupBy(_suffix(F.col("key"), k).alias("key")).agg(F.sum("n").alias("n"))
        levels.insert(0, materialize(shorter, f"ppm-order-{k}"))
    return levels


def contexts(levels: list[DataFrame]) -> list[DataFrame]:
    """Per order the known contexts with the sum of counts, the number of symbols, and the counts these symbols have in the
    next shorter context (``context, total, symbols, below``)."""
    out = []
    for k, level in enumerate(levels):
        if k:
            shorter = levels[k - 1].select(F.col("key").alias("suffix"), F.col("n").alias("shorter"))
            level = level.withColumn("suffix", _suffix(F.col("key"), k - 1)).join(shorter, "suffix")
        else:
            level = level.withColumn("shorter", F.lit(0).cast("bigint"))
        out.append(level.groupBy(_context(F.col("key")).alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("symbols"), F.sum("shorter").alias("below")))
    return out


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, value``: log10 of each gram's probability, for all grams of ``counts (key, n)``; those with ``n = 0`` are not learned."""
    levels = trie(counts, order)
    known = [materialize(c, f"ppm-contexts-{k}") for k, c in enumerate(contexts(levels))]
    seen = levels[order].withColumn("context", _context(F.col("key"))).join(known[order], "context").select(
        "key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
    zero = F.lit(0).cast("bigint")
    rest = counts.where("n = 0").select("key", F.lit(0.0).alias("value"), F.lit(False).alias("done"),
                                        zero.alias("excluded"), zero.alias("fewer"))
    for k in range(order, -1, -1):
        rest = rest.withColumn("suffix", _suffix(F.col("key"), k)).withColumn("context", _context(F.col("suffix")))
        rest = rest.join(known[k], "context", "left")
        if k < order:
            rest = rest.join(levels[k].select(F.col("key").alias("suffix"), "n"), "suffix", "left")
        else:
            rest = rest.withColumn("n", F.lit(None).cast("bigint"))
        mass, symbols = F.col("total") - F.col("excluded"), F.col("symbols") - F.col("fewer")
        step = (F.when(F.col("done"), F.lit(0.0)).when(F.col("n").isNotNull(), F.log10((F.col("n") - 0.5) / mass))
                .when(symbols > 0, F.log10(symbols / 2 / mass)).otherwise(F.lit(0.0)))
        rest = rest.select(
            "key", (F.col("value") + step).alias("value"), (F.col("done") | F.col("n").isNotNull()).alias("done"),
            F.coalesce("below", "excluded").alias("excluded"), F.coalesce("symbols", "fewer").alias("fewer"))
    left = F.log10(F.lit(1.0) / (SYMBOLS - F.col("fewer")))
    return seen.unionByName(rest.select("key", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + left).alias("value")))


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """The values of each pack's grams and the counts of its words, in the pack's order."""
    own = right.filter(pc.is_valid(right.column("key")))
    keys, values = own.column("key").to_numpy(), own.column("value").to_numpy()
    at = np.argsort(keys)
    keys, values = keys[at], values[at]
    own = right.filter(pc.is_valid(right.column("word")))
    known, counts = own.column("word").combine_chunks(), own.column("n").to_numpy()
    found = [packs.numbers(values[np.searchsorted(keys, packs.read_ascending(raw))]) for raw in left.column("grams").to_pylist()]
    held = [packs.numbers(counts[pc.index_in(packs.read_words(raw), known).to_numpy().astype(np.int64)])
            for raw in left.column("words").to_pylist()]
    return pa.table({"slice": left.column("slice"), "bucket": left.column("bucket"),
                     "values": pa.array(found, pa.binary()), "known": pa.array(held, pa.binary())})


ANSWERED = "slice bigint, bucket int, values binary, known binary"


def _score(order: int, total: int, vocabulary: int):
    def told(rows: pa.Table) -> Iterator[tuple]:
        return zip(*(rows.sort_by("bucket").column(c).to_pylist() for c in rows.column_names[2:]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = left.filter(pc.is_valid(left.column("bucket"))).select(["slice", "bucket", "grams", "words"])
        asked, answers = list(told(packed)), list(told(right))
        keys = np.concatenate([packs.read_ascending(g) for g, _ in asked])
        values = np.concatenate([packs.read_numbers(v, np.float64) for v, _ in answers])
        words = pa.concat_arrays([packs.read_words(w) for _, w in asked])
        counts = np.concatenate([packs.read_numbers(n) for _, n in answers])
        left = left.filter(pc.is_null(left.column("bucket")))
        at = np.argsort(keys)
        keys, values = keys[at], values[at]
        end = counts[pc.index(words, "").as_py()]
        out = []
        for whole in left.to_batches():
            for batch in slices(whole, limit=BLOCK):
                texts, n = batch.column("text"), batch.num_rows
                found, doc = grams(texts, order)
                distinct = pa.array(found).dictionary_encode()
                value = values[np.searchsorted(keys, distinct.dictionary.to_numpy())][distinct.indices.to_numpy()]
                score = np.bincount(doc, weights=value, minlength=n)
                places, codes, own = split(texts)
                known = pc.index_in(pa.array(own, pa.string()), words).to_numpy(zero_copy_only=False)
                count = counts[known[codes].astype(np.int64)]
                of = np.repeat(np.arange(n), np.diff(places))
                base = np.log10((np.append(count, end) + 1) / (total + vocabulary + 1))
                out.append(pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(places) + 1),
                     pa.array(np.bincount(of, weights=count > 0, minlength=n).astype(np.int64) + int(end > 0)),
                     pa.array(np.bincount(of, weights=base[:-1], minlength=n) + base[-1]), pa.array(score)],
                    [x.split()[0] for x in SCORED.split(", ")]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)
    return run


def score(docs: DataFrame, order: int = ORDER, slice_bytes: int = SLICE, group: int = GROUP) -> DataFrame:
    """One row per document: the log10 probability of its text by the trie, and by its words alone (``base_score``)."""
    buckets = _buckets(docs)
    rows = dealt(docs, order, slice_bytes, buckets)
    dealt_packs = rows.where("bucket is not null")
    sums = materialize(dealt_packs.select("bucket", "grams", "counts", "words", "word_counts").repartition("bucket")
                       .mapInArrow(_sum, "key bigint, word string, n bigint"), "ppm-sums")
    counts = materialize(sums.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), "ppm-grams")
    words = materialize(sums.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    values = log_probabilities(counts, order).select(
        F.pmod(F.shiftright("key", LOW_BITS), F.lit(buckets)).cast("int").alias("bucket"), "key", "value",
        F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("n"))
    values = values.unionByName(words.select(
        F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("key"),
        F.lit(None).cast("double").alias("value"), "word", "n"))
    largest = dealt_packs.groupBy("bucket").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // group) or 1
    asked = dealt_packs.select("bucket", F.pmod("slice", F.lit(parts)).alias("part"), "slice", "grams", "words")
    told = values.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    answers = asked.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(_answer, ANSWERED)
    texts = rows.select("slice", "bucket", "doc_id", "held_out", "text", "grams", "words")
    scored = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        _score(order, int(totals["n"]), int(totals["v"])), SCORED)
    return scored.withColumn("train_tokens", F.lit(int(totals["n"])).cast("bigint"))
