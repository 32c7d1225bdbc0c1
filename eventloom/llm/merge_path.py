"""Alignment of the tokens of two vocabularies by merge-path partitioning, and how good each link is in the corpus.

1. Both vocabularies encode every text; the ends of their tokens are two ascending lists of byte offsets.
2. Merging the lists is a path through a grid, one step per end. Binary searches along evenly spaced diagonals cut the path
   into pieces of equal work that need nothing from each other. Each piece merges its own ends and
   emits overlaps: the stretches of text that one A token and one B token share, and whether both end there.
3. A group of tokens closes where both end. Groups run across pieces; the pieces are stitched by a prefix sum of how
   many groups each closes, which numbers every token's group.
4. Links are overlaps where both tokens end. Their numbers per pair of ids are summed over the corpus. Pairs
   with more than 1/65536 of all links number at most 65536, so they are broadcast; the others are spread by pair, and
   no pair then brings more than that share to one task.

Texts are spread over tasks, a Python worker holds a slice of ``SLICE`` bytes (or one longer text), and the aligned
rows are written to the shared folder, which the two passes over the links read.

Defined cases: a null or empty text, and one whose bytes a vocabulary does not give back (such as one with U+2581),
has no tokens and zeros; null and repeated ids and repeated rows stay rows of their own and all count; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import pick, slices
from eventloom.llm.token_pairs import PIECES, PairEncoder, Tokens
from eventloom.llm.tokens import RANKS
from eventloom.session import materialize

SLICE = 2 << 20
#: Steps of the merge in one piece.
WORK = 1 << 16
#: At most so many pairs hold more than 1/HEAVY of all links each.
HEAVY = 1 << 16

ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, held array<int>")


def cross(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Where the merge path of two ascending lists crosses each diagonal: how many ends of ``a`` come before it.

    All diagonals are searched at once. Of equal ends the one of ``a`` comes first.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # a[middle] is before the diagonal if it comes no later than the b that would be taken in its place
        takes = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - middle - 1, 0, len(b) - 1)])
        low = np.where(takes, middle + 1, low)
        high = np.where(open_ & ~takes, middle, high)
    return low


@dataclass
class Piece:
    """What a piece emits: its overlaps as pairs of token numbers, the end of each, and which ones both tokens end."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    closes: np.ndarray


def merge(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> Piece:
    """Merge ``a[i[0]:i[1]]`` with ``b[j[0]:j[1]]``; all other ends of the lists lie before or behind these."""
    own_a, own_b = a[i[0]:i[1]], b[j[0]:j[1]]
    ends = np.union1d(own_a, own_b)
    in_a, in_b = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    closes = np.zeros(len(ends), bool)
    inside = (in_a < len(own_a)) & (in_b < len(own_b))
    closes[inside] = own_a[in_a[inside]] == own_b[in_b[inside]]
    return Piece(i[0] + in_a, j[0] + in_b, ends, closes)


def cut(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces in both lists: evenly spaced diagonals, moved by one step where equal ends would be parted."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, work), total)
    at_a = cross(a, b, diagonals)
    at_b = diagonals - at_a
    if len(a) and len(b):
        parted = (at_a > 0) & (at_b < len(b)) & (a[np.maximum(at_a - 1, 0)] == b[np.minimum(at_b, len(b) - 1)])
        at_b = at_b + parted
    return at_a, at_b


@dataclass
class Alignment:
    """Overlaps of all pieces, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    closes: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Alignment:
    """Align two lists of token ends that cover the same bytes, piece by piece."""
    at_a, at_b = (x.tolist() for x in cut(a, b, work))
    pieces = [merge(a, b, i, j) for i, j in zip(zip(at_a, at_a[1:]), zip(at_b, at_b[1:]))]
    # stitch: a piece's groups are numbered on from those closed before it
    closed = np.cumsum([0, *(int(p.closes.sum()) for p in pieces)])
    group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for piece, before in zip(pieces, closed.tolist()):
        group = before + np.cumsum(piece.closes) - piece.closes
        # a token that ends in a later piece is overwritten there, by the group its last overlap is in
        has_a, has_b = piece.a < len(a), piece.b < len(b)
        group_a[piece.a[has_a]], group_b[piece.b[has_b]] = group[has_a], group[has_b]
    joined = [np.concatenate([getattr(p, name) for p in pieces] or [np.zeros(0, np.int64)]) for name in ("a", "b", "ends")]
    closes = np.concatenate([p.closes for p in pieces] or [np.zeros(0, bool)])
    return Alignment(*joined, closes, group_a, group_b)


def _digits(size: int) -> np.ndarray:
    """Decimal ids with each of three closing characters, as rows of bytes filled up with zeros."""
    return np.array([f"{i}{end}".encode() for i in range(size) for end in ",|;"]).view(np.uint8).reshape(size * 3, -1)


def written(a: Tokens, b: Tokens, found: Alignment, digits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all texts in a row, and where each text's begins."""
    closed = int(found.closes.sum())
    n_a = np.bincount(found.group_a, minlength=closed)
    n_b = np.bincount(found.group_b, minlength=closed)
    last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    codes = np.empty(len(a.ids) + len(b.ids), np.int64)
    at_a = np.arange(len(a.ids)) + (last_b + 1 - n_b)[found.group_a]
    at_b = np.arange(len(b.ids)) + (last_a + 1)[found.group_b]
    codes[at_a], codes[at_b] = a.ids * 3, b.ids * 3
    codes[at_a[last_a]] += 1
    codes[at_b[last_b]] += 2
    rows = digits[codes]
    full = rows != 0
    lengths = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(full.sum(axis=1), out=lengths[1:])
    return rows[full].tobytes(), lengths[a.places + b.places]


def _aligned(ranks: str, pieces: str, work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairEncoder(ranks, pieces)
        digits = _digits(max(len(encoder.a_sizes), len(encoder.b_sizes)))
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                a, b = encoder.encode(batch.column("text"))
                found = align(a.ends, b.ends, work)
                texts, at = written(a, b, found, digits)
                view, bounds = memoryview(texts), at.tolist()
                hashes = [hashlib.sha256(view[x:y - 1]).hexdigest() if x < y else "" for x, y in zip(bounds, bounds[1:])]
                link_a, link_b = found.a[found.closes], found.b[found.closes]
                doc = np.searchsorted(a.places, link_a, side="right") - 1
                links = np.bincount(doc, minlength=batch.num_rows)
                pair = (a.ids[link_a].astype(np.int64) << 32) | b.ids[link_b]
                # sorted by text and pair, each pair once with its number in the text
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[:len(doc)])
                held = np.diff(np.append(first, len(doc))).astype(np.int32)
                offsets = np.zeros(batch.num_rows + 1, np.int32)
                np.cumsum(np.bincount(doc[first], minlength=batch.num_rows), out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(a.places)), pa.array(np.diff(b.places)), pa.array(links),
                     pa.array(links), pa.array(hashes, pa.string()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair[first])),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(held))],
                    [x.split()[0] for x in ALIGNED.split(", ")])
    return run


def aligned(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES, work: int = WORK) -> DataFrame:
    """One row per document with its counts, the hash of its groups, and its linked pairs with their numbers."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_aligned(ranks, pieces, work), ALIGNED)


def _overlaps(ranks: str, pieces: str, work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairEncoder(ranks, pieces)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                a, b = encoder.encode(batch.column("text"))
                found = align(a.ends, b.ends, work)
                doc = np.searchsorted(a.places, found.a, side="right") - 1
                base = np.append(0, a.ends)[a.places[doc]]
                group = np.cumsum(found.closes) - found.closes
                first = np.append(0, np.cumsum(found.closes))[np.searchsorted(doc, np.arange(batch.num_rows))]
                starts = np.append(0, found.ends[:-1])[:len(found.ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(group - first[doc]),
                     pa.array(found.a - a.places[doc]), pa.array(found.b - b.places[doc]),
                     pa.array(a.ids[found.a]), pa.array(b.ids[found.b]),
                     pa.array(starts - base), pa.array(found.ends - base), pa.array(found.closes)],
                    [x.split()[0] for x in OVERLAPS.split(", ")])
    return run


OVERLAPS = ("doc_id bigint, token_group bigint, place_a bigint, place_b bigint, id_a int, id_b int, "
            "start_byte bigint, end_byte bigint, linked boolean")


def overlaps(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES, work: int = WORK) -> DataFrame:
    """One row per stretch of a text that an A token and a B token share, with their group; bytes count from the added space."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_overlaps(ranks, pieces, work), OVERLAPS)


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, links, best``: corpus-wide links of each id pair, and whether no other A id has more with the same B id.

    ``links`` has ``pair`` (A id in the upper half, B id in the lower) and ``held``.
    """
    counted = materialize(links.groupBy("pair").agg(F.sum("held").alias("links")), "pair-counts")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(id_b.alias("id_b")).agg(F.max("links").alias("highest"))
    return counted.withColumn("id_b", id_b).join(highest, "id_b").select(
        "pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def align_corpus(docs: DataFrame, **how) -> DataFrame:
    """Per document its counts, the hash of its groups, and how its links fare in the corpus."""
    rows = materialize(aligned(docs, **how).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "held"))).withColumnRenamed("pairs", "pair")
    counts = materialize(pair_counts(links), "pairs")
    total = rows.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("links") * HEAVY > total
    scored = (F.sum(F.when(F.col("best"), F.col("held")).otherwise(0)).alias("n_best"),
              F.sum(F.col("held") * F.col("links")).alias("count_sum"))
    # fewer than HEAVY pairs can pass the bound, whatever the input
    heavy = links.join(F.broadcast(counts.where(often)), "pair").groupBy("row").agg(*scored)
    rare = links.join(F.broadcast(counts.where(often).select("pair")), "pair", "left_anti")
    light = rare.join(counts.where(~often), "pair").groupBy("row").agg(*scored)
    none = F.lit(0).cast("bigint")
    sums = heavy.unionByName(light).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "held").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
