"""Near duplicates by ProbMinHash: weighted five-word shingles, banded signatures, exact verification.

Signatures (Ertl's ProbMinHash): each distinct shingle of a text is a Poisson process whose rate is its number of
occurrences; every arrival goes to a random register, and a register holds the shingle that arrived first. A
shingle stops when its next arrival is later than all registers' first ones. Two registers agree with the
probability Jaccard similarity of the texts.

Steps: (1) one pass over the texts gives a content hash, equal for exact copies up to white space, and a hash per
band; (2) per band the smallest content is the leader, by a map-side combined minimum; (3) the other contents
of a band are verified against its leader on their texts; (4) verified pairs are joined to components; (5) bands whose
contents still lie in several components are dealt into tiles of bounded size. A task compares the long signatures of two
tiles and passes on the pairs of different components whose estimate is less than four standard errors below the
threshold, likely ones first; these are verified too. So copies are never expanded, a hot band costs one pass where
its contents are alike, pairs within a component are not looked at again, and no candidate is dropped for its number.

What can be missed is a matter of chance only: a pair at the threshold shares no band with probability
``(1 - 0.8 ** ROWS) ** BANDS`` (6e-5), and is estimated four standard errors too low with 3e-5.

Content hashes have 64 bits: two of n different texts share one with a probability of about n * n / 2**65.

Defined cases: a text of one to four words is one shingle; null and empty texts and those of white space are copies of
each other; rows alike in id and text are one document; null ids are kept as they are (and come first as
representatives); other columns are ignored, or kept by ``without_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.components import star_forest
from eventloom.llm.frames import ROWS_PER_TASK, TEXTS_PER_TASK, pick, place, positional, slices
from eventloom.llm.words import split
from eventloom.session import gathered, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Registers of the signatures by which pairs in open bands are estimated, and contents per tile of such a band.
LONG_REGISTERS = 1024
TILE = 512
REGISTERS_AT_ONCE = 1 << 19
#: Arrivals drawn at once while few shingles go on; without it a text of one shingle takes thousands of steps.
ARRIVALS_AT_ONCE = 1 << 12
SLICE_BYTES = 4 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
               np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of all words of the texts."""
    places, codes, words = split(texts)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return places, table[codes] if len(table) else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, sorted, and how often each occurs."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(n, SHINGLE)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += mixed(words[i:n - width + 1 + i] + ODD[i]) * ODD[i]
    return np.unique(mixed(total), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """Registers (texts by ``registers``) holding 32 bits of the shingle that arrived first; 0 where a text has none.

    Texts go through in groups of about ``REGISTERS_AT_ONCE`` registers, which bounds the memory of a task.
    """
    step = max(1, REGISTERS_AT_ONCE // registers)
    parts = [_signatures(sets[i:i + step], registers) for i in range(0, len(sets), step)]
    return np.concatenate([np.zeros((0, registers), np.uint32), *parts])


def _signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    n = len(sets)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.full(n * registers, empty)
    text = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    if len(text):
        element = np.concatenate([s for s, _ in sets])
        rate = np.concatenate([c for _, c in sets]).astype(np.float64)
        time = np.zeros(len(text))
        arrival = 0
        while len(text):
            block = max(1, ARRIVALS_AT_ONCE // len(text))
            number = np.arange(arrival + 1, arrival + block + 1, dtype=np.uint64) * ODD[0]
            arrival += block
            draw = mixed(element[:, None] + number)
            register = ((draw & np.uint64(0xFFFF)) * np.uint64(registers)) >> np.uint64(16)
            steps = -np.log(((draw >> np.uint64(16)).astype(np.float64) + 0.5) / (1 << 48)) / rate[:, None]
            steps[:, 0] += time
            times = np.cumsum(steps, axis=1)
            # positive floats order as their bits do, so one minimum keeps the earliest time and its shingle
            bits = times.astype(np.float32).view(np.uint32).astype(np.uint64)
            packed = (bits << np.uint64(32)) | (element & np.uint64(0xFFFFFFFF))[:, None]
            at = (text * registers)[:, None] + register.astype(np.int64)
            np.minimum.at(first, at.reshape(-1), packed.reshape(-1))
            open_texts = text[np.flatnonzero(np.diff(text, prepend=-1))]
            latest = np.zeros(n, np.uint64)
            latest[open_texts] = first.reshape(n, registers)[open_texts].max(axis=1) >> np.uint64(32)
            going = bits[:, -1] < latest[text]
            text, element, rate, time = text[going], element[going], rate[going], times[going, -1]
    first[first == empty] = 0
    return (first & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n = len(signature)
    rows = signature.astype(np.uint64).reshape(n, bands, -1)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows.shape[2]):
        total = mixed(total * ODD[0] + rows[:, :, i])
    return total.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets: over common elements d, the sum of
    1 / sum over all elements e of max(a(e) / a(d), b(e) / b(d)). In n log n steps by sorting the ratios a / b."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])] = a[1]
    wb[np.searchsorted(every, b[0])] = b[1]
    common = (wa > 0) & (wb > 0)
    if not common.any():
        return 0.0
    ratio = np.full(len(every), np.inf)
    np.divide(wa, wb, out=ratio, where=wb > 0)
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    below_b = np.concatenate([[0.0], np.cumsum(wb[order])])
    below_a = np.concatenate([[0.0], np.cumsum(wa[order])])
    at = np.searchsorted(sorted_ratio, ratio[common], side="left")
    total = (below_a[-1] - below_a[at]) / wa[common] + below_b[at] / wb[common]
    return float((1.0 / total).sum())


def _content(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, limit=SLICE_BYTES):
            places, words = word_hashes(batch.column("text"))
            parts = [words[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            content = [_content(part) for part in parts]
            bands = band_hashes(signatures([shingles(part) for part in parts]))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(parts) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(content, pa.int64()), lists],
                ["doc_id", "version", "content", "bands"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            places, words = word_hashes(batch.column("text"))
            content = [_content(words[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), batch.column("text")], ["content", "text"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, known = None, None
        for whole in batches:
            for batch in slices(whole, "b_text", SLICE_BYTES):
                places, words = word_hashes(batch.column("b_text"))
                keep = np.zeros(batch.num_rows, bool)
                for i, a in enumerate(batch.column("a").to_pylist()):
                    if a != leader:  # rows come sorted by leader, as the join leaves them
                        leader, known = a, shingles(word_hashes(batch.column("a_text").slice(i, 1))[1])
                    other = shingles(words[places[i]:places[i + 1]])
                    keep[i] = probability_jaccard(known, other) >= similarity
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])
    return run


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, version, content, bands`` per row, written to the shared folder."""
    named = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("version"), "text")
    return materialize(named.mapInArrow(_sign, "doc_id bigint, version bigint, content bigint, bands array<bigint>"),
                       "signatures")


class Verifier:
    """Checks pairs of contents on their texts."""

    def __init__(self, docs: DataFrame, rows: DataFrame, wanted: DataFrame, similarity: float):
        """``wanted`` (``content``): all contents that pairs may name; one text of each is written."""
        named = pick(docs, "doc_id", "text").select(_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("of"), "text")
        one = rows.groupBy("content").agg(F.min(F.struct(_id(F.col("doc_id")).alias("id"), "version")).alias("row"))
        one = one.join(wanted, "content", "left_semi").select("row.id", F.col("row.version").alias("of"))
        texts = named.join(one, ["id", "of"], "left_semi").select("text")
        self.texts = materialize(gathered(texts, rows.count(), TEXTS_PER_TASK).mapInArrow(
            _contents, "content bigint, text string"), "near-texts")
        self.similarity = similarity

    def links(self, pairs: DataFrame) -> DataFrame:
        """``u, v`` of those ``pairs (a, b, u, v)`` whose contents ``a`` and ``b`` are similar enough."""
        a = self.texts.select(F.col("content").alias("a"), F.col("text").alias("a_text"))
        b = self.texts.select(F.col("content").alias("b"), F.col("text").alias("b_text"))
        joined = pairs.join(b, "b").join(a, "a").select("a", "u", "v", "a_text", "b_text")
        return joined.mapInArrow(_verify(self.similarity), "u bigint, v bigint")


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight bits of each of ``LONG_REGISTERS`` registers, and the band hashes."""
    for whole in batches:
        for batch in slices(whole, limit=SLICE_BYTES):
            places, words = word_hashes(batch.column("text"))
            sets = [shingles(words[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            signs = [mixed(x.astype(np.uint64)).astype(np.uint8) for x in signatures(sets, LONG_REGISTERS)]
            bands = band_hashes(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([x.tobytes() for x in signs], pa.binary()),
                 pa.array([x.tobytes() for x in bands], pa.binary())], ["content", "sign", "bands"])


def _pairs_of_tiles(group: pa.Table, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in a group of one or two tiles: different components, this band their first common one, and an
    estimate from ``low`` up to ``high``."""
    roots, tiles = group.column("root").to_numpy(), group.column("tile").to_numpy()
    band = group.column("band")[0].as_py()
    signs, bands = (np.stack([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
                    for name, kind in (("sign", np.uint8), ("bands", np.int64)))
    number = int(np.flatnonzero((bands == band).all(axis=0))[0])
    one = tiles[0] == tiles[-1] and (tiles == tiles[0]).all()
    left = np.arange(len(roots)) if one else np.flatnonzero(tiles == tiles.min())
    right = left if one else np.flatnonzero(tiles != tiles.min())
    out_a, out_b = [], []
    for i in left.tolist():
        others = right[(right > i) if one else slice(None)]
        others = others[roots[others] != roots[i]]
        if number and len(others):
            others = others[(bands[others, :number] != bands[i, :number]).all(axis=1)]
        if len(others):
            # unrelated registers agree in eight bits once in 256
            agree = (signs[others] == signs[i]).mean(axis=1)
            estimate = (agree - 1 / 256) / (1 - 1 / 256)
            others = others[(estimate >= low) & (estimate < high)]
            out_a.append(np.full(len(others), i))
            out_b.append(others)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compare(low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by band and tiles; a group may go on in the next batch."""
        def pairs(group: pa.Table) -> pa.RecordBatch:
            a, b = _pairs_of_tiles(group, low, high)
            content, root = (group.column(name).to_numpy() for name in ("content", "root"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (content[a], content[b], root[a], root[b])],
                                              ["a", "b", "u", "v"])

        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            key = np.stack([table.column(c).to_numpy() for c in ("band", "t1", "t2")])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    yield pairs(table.slice(a, b - a))
            kept = table.slice(int(starts[-1]))
        if kept is not None and kept.num_rows > 1:
            yield pairs(kept)
    return run


def _relabelled(labelled: DataFrame, forest: DataFrame) -> DataFrame:
    """``labelled`` with each ``root`` that is a node of the ``forest`` replaced by that node's root."""
    above = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return labelled.join(above, "root", "left").withColumn("root", F.coalesce("above", "root")).select(*labelled.columns)


def _open(labelled: DataFrame) -> DataFrame:
    """``band, content, root`` of the bands whose contents lie in several components."""
    several = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return labelled.join(several.select("band"), "band", "left_semi")


def _tiled(left: DataFrame) -> DataFrame:
    """Rows of ``left`` once for each group of tiles they are compared in: ``band, t1, t2, tile, content, root``.

    The largest component of a band has tiles of its own, which are compared with those of the other contents only.
    """
    counts = left.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select(
        "band", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / TILE).alias("n_top"),
        F.ceil((F.col("all") - F.col("top.n")) / TILE).alias("n_rest"))
    placed = left.join(large, "band")
    draw = F.xxhash64(F.lit("tile"), "content")
    own = F.when(F.col("root") == F.col("top"), F.pmod(draw, F.col("n_top"))).otherwise(
        F.col("n_top") + F.pmod(draw, F.col("n_rest")))
    placed = placed.withColumn("tile", own)
    rest = F.sequence(F.col("n_top"), F.col("n_top") + F.col("n_rest") - 1)
    every = F.sequence(F.lit(0).cast("bigint"), F.col("n_top") + F.col("n_rest") - 1)
    other = F.explode(F.when(F.col("tile") < F.col("n_top"), rest).otherwise(every))
    return placed.withColumn("other", other).select(
        "band", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "content", "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, version, content, root``: rows of one near-duplicate class share ``root``."""
    rows = signed(docs)
    n = rows.count()
    banded = rows.select("content", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("content").alias("leader"), F.max("content").alias("last")).where(
        "leader < last").select("band", "leader")
    members = banded.join(buckets, "band").select("band", "leader", "content").distinct()
    members = materialize(gathered(members, n, ROWS_PER_TASK), "band-members")
    pairs = members.where("leader <> content").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct()
    verifier = Verifier(docs, rows, members.select("content").distinct(), similarity)
    roots = star_forest(verifier.links(pairs.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))), n)
    left = _open(_relabelled(members.select("band", "content", F.col("content").alias("root")), roots))
    left = materialize(gathered(left, n, ROWS_PER_TASK), "open-bands")
    if not left.isEmpty():
        signs = materialize(
            gathered(verifier.texts.join(left.select("content").distinct(), "content", "left_semi"), n, TEXTS_PER_TASK)
            .mapInArrow(_long_signatures, "content bigint, sign binary, bands binary"), "long-signatures")
        floor = similarity - 4 * (similarity * (1 - similarity) / LONG_REGISTERS) ** 0.5
        for low, high in ((similarity, 2.0), (floor, similarity)):
            tiles = _tiled(left).join(signs, "content")
            dealt = tiles.repartition("band", "t1", "t2").sortWithinPartitions("band", "t1", "t2", "tile")
            more = dealt.select("band", "t1", "t2", "tile", "content", "root", "sign", "bands").mapInArrow(
                _compare(low, high), "a bigint, b bigint, u bigint, v bigint")
            # links between components of before: their graph has as many edges as there is left to join
            joined = star_forest(verifier.links(more), n)
            roots = _relabelled(roots, joined).unionByName(joined)
            if high > similarity:
                left = materialize(gathered(_open(_relabelled(left, joined)), n, ROWS_PER_TASK), "open-bands")
                if left.isEmpty():
                    break
    return rows.join(roots, F.col("content") == F.col("node"), "left").select(
        "doc_id", "version", "content", F.coalesce("root", "content").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` per row; the class id is the smallest document id of the class."""
    found = classes(docs, similarity)
    names = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(names, "root").select("doc_id", "class_id", "class_size")


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of smallest id of each class only, all columns kept."""
    found = classes(docs, similarity)
    keepers = found.groupBy("root").agg(F.min(F.struct(_id(F.col("doc_id")).alias("id"), "version")).alias("keep")).select(
        F.col("keep.id").alias("keep_id"), F.col("keep.version").alias("keep_version"))
    keepers = materialize(gathered(keepers, docs.count(), ROWS_PER_TASK), "keepers")
    row = positional(docs)
    doc_id, text = (F.col(place(docs, x)) for x in ("doc_id", "text"))
    marked = row.withColumn("keep_id", _id(doc_id)).withColumn("keep_version", F.xxhash64(text))
    kept = marked.join(keepers, ["keep_id", "keep_version"], "left_semi").dropDuplicates(["keep_id", "keep_version"])
    return kept.drop("keep_id", "keep_version").toDF(*docs.columns)
