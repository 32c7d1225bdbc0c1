"""Exact top-k by inner product: vectors keyed by nearest pivot and distance, searched ring by ring.

Inner products become distances by one more coordinate: ``x`` gets ``sqrt(M^2 - |x|^2)`` with ``M`` the largest
norm, a query 0, so ``distance^2 = |q|^2 + M^2 - 2 q.x`` falls as the product grows. Each vector is keyed by its nearest
pivot and the ring (annulus) around it that its distance falls in. For a query, the triangle inequality bounds
the distance to anything in a ring from below, and so does the bisector between the ring's pivot and the query's nearest
one. Rings in order of that bound are searched first until they hold enough vectors for a k-th best score; then exactly
those rings whose bound does not exceed it. Scores are integer products; the bounds only have to be safe.

Equal vectors are kept once with their k + 1 smallest ids (no more can be among the k best of a query, which may be one
of them), by a rank limit that Spark applies before the shuffle. Vectors of a ring lie in blocks of bounded size,
queries in packs of bounded size; a task multiplies one pack with one block at a time. What the driver holds is the pivots
and the directory of rings, both bounded by ``PIVOTS`` and ``RINGS``.

Defined cases: null vectors, those holding nulls or non-finite numbers, and null ids take no part; rows alike in id and
vector count once; a query leaves out all rows of its own id; shorter vectors count as filled up with zeros; ties go to the
smaller id; with fewer than k others all are returned. Products must stay below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.frames import pick
from eventloom.llm.hashing import chosen
from eventloom.session import materialize

K = 10
SCALE = 1024
PIVOTS = 32
RINGS = 16
#: Bound of the sample from which pivots are chosen, in vectors.
PIVOT_SAMPLE = 2_000
BLOCK_VECTORS = 1_024
PACK_QUERIES = 256
#: Vectors per salt of a ring; a ring with more is dealt to several tasks.
SALT_VECTORS = 16_384
#: Vectors that the first rings of a query must hold.
FIRST_VECTORS = 256
SLACK = 1e-6


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def valid(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    named = pick(rows, "vec_id", "embedding")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~broken).select(
        F.col("vec_id").cast("bigint"), quantised(F.col("embedding")).alias("v"))


@dataclass
class Space:
    """The extended space: its dimension, squared largest norm, and pivots (extended, as rows)."""

    size: int
    largest: float
    pivots: np.ndarray
    width: float = 1.0

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """Integer vectors as rows, filled up with zeros."""
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(lengths) and (lengths == self.size).all():
            return flat.reshape(len(lengths), self.size).astype(np.int64)
        out = np.zeros((len(lengths), self.size), np.int64)
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out

    def extended(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0.0))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From extended vectors to all pivots."""
        square = (x * x).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1)[None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    @property
    def slack(self) -> float:
        return SLACK * (1.0 + np.sqrt(self.largest))


def space_of(vectors: DataFrame, pivots: int = PIVOTS) -> Space | None:
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size, largest = vectors.agg(F.max(F.size("v")), F.max(square)).first()
    if size is None:
        return None
    space = Space(max(size, 1), largest, np.zeros((0, max(size, 1) + 1)))
    sample = chosen(vectors, "vec_id", PIVOT_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    points = space.extended(space.matrix(sample))
    # farthest first: each next pivot is the sample's point farthest from those taken
    taken, nearest = [0], np.full(len(points), np.inf)
    while True:
        nearest = np.minimum(nearest, ((points - points[taken[-1]]) ** 2).sum(axis=1))
        if len(taken) == pivots or nearest.max() <= space.slack ** 2:
            break
        taken.append(int(nearest.argmax()))
    space.pivots = points[taken]
    space.width = max(2 * float(np.sqrt(largest)) / RINGS, 1e-9)
    return space


def _key(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = space.distances(space.extended(space.matrix(batch.column("v"))))
            pivot = away.argmin(axis=1)
            radius = away[np.arange(len(pivot)), pivot]
            ring = np.minimum((radius / space.width).astype(np.int64), RINGS - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot * RINGS + ring, pa.int64()), pa.array(radius), batch.column("v"), batch.column("ids")],
                ["cell", "radius", "v", "ids"])
    return run


def index(vectors: DataFrame, space: Space, k: int = K) -> DataFrame:
    """``cell, radius, v, ids``: distinct vectors keyed by pivot and ring, with their ``k + 1`` smallest ids."""
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    kept = vectors.distinct().withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= k + 1)
    once = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(once.mapInArrow(_key(space), "cell bigint, radius double, v array<bigint>, ids array<bigint>"), "pivot-index")


def _blocks(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, salts = batch.column("cell").to_numpy(), batch.column("salt").to_numpy()
            starts = np.flatnonzero((np.diff(cells, prepend=-1) != 0) | (np.diff(salts, prepend=-1) != 0))
            cuts = [x for a, b in zip(starts, np.append(starts[1:], len(cells))) for x in range(a, b, BLOCK_VECTORS)]
            out: list[tuple] = []
            for a, b in zip(cuts, [*cuts[1:], len(cells)]):
                part = batch.slice(a, b - a)
                ids = part.column("ids")
                counts = np.diff(ids.offsets.to_numpy())
                out.append((int(cells[a]), int(salts[a]), space.matrix(part.column("v")).tobytes(),
                            ids.flatten().to_numpy().tobytes(), counts.astype(np.int32).tobytes()))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["cell", "salt", "vectors", "ids", "counts"])
    return run


@dataclass
class Directory:
    """The rings that hold vectors: number, pivot, innermost and outermost distance, count, salts."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    @property
    def pivot(self) -> np.ndarray:
        return self.cell // RINGS

    @property
    def salts(self) -> np.ndarray:
        return -(-self.count // SALT_VECTORS)

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each ring, from the queries' distances to the pivots."""
        own = away[:, self.pivot]
        triangle = np.maximum(own - self.high[None], self.low[None] - own)
        bisector = (own - away.min(axis=1, keepdims=True)) / 2
        return np.maximum(np.maximum(triangle, bisector), 0.0)


PACK = "cell bigint, salt bigint, q_ids binary, q_vectors binary, floors binary"


def _pack(space: Space, rings: Directory, first: bool, k: int):
    """Packs of queries for the rings they visit: the first ones, or with a k-th best score all that may hold better."""
    order_floor = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK_QUERIES):
                batch = whole.slice(at, PACK_QUERIES)
                x = space.matrix(batch.column("v"))
                ids = batch.column("vec_id").to_numpy()
                floors = np.full(len(ids), order_floor) if first else batch.column("floor").fill_null(order_floor).to_numpy()
                real = x.astype(np.float64)
                square = (real * real).sum(axis=1)
                bounds = rings.bounds(space.distances(np.column_stack([real, np.zeros(len(ids))])))
                nearest = np.argsort(bounds, axis=1, kind="stable")
                held = np.cumsum(rings.count[nearest], axis=1)
                initial = np.zeros(bounds.shape, bool)
                np.put_along_axis(initial, nearest, held - rings.count[nearest] < FIRST_VECTORS, axis=1)
                if first:
                    visit = initial
                else:
                    reach = square + space.largest - 2.0 * floors.astype(np.float64)
                    reach = np.where(floors == order_floor, np.inf, np.sqrt(np.maximum(reach, 0.0)))
                    visit = (bounds <= reach[:, None] * (1 + SLACK) + space.slack) & ~initial
                out = []
                for ring in np.flatnonzero(visit.any(axis=0)):
                    some = visit[:, ring]
                    packed = (ids[some].tobytes(), x[some].tobytes(), floors[some].tobytes())
                    out += [(int(rings.cell[ring]), salt, *packed) for salt in range(int(rings.salts[ring]))]
                columns = list(zip(*out)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 ["cell", "salt", "q_ids", "q_vectors", "floors"])
    return run


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where no partial sum can reach 2^53."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < 2.0 ** 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _search(space: Space, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            raw = {name: batch.column(name) for name in ("q_ids", "q_vectors", "floors", "vectors", "ids", "counts")}
            for i in range(batch.num_rows):
                part = {name: column[i].as_buffer() for name, column in raw.items()}
                q_ids, floors = (np.frombuffer(part[x], np.int64) for x in ("q_ids", "floors"))
                vectors = np.frombuffer(part["vectors"], np.int64).reshape(-1, space.size)
                scores = _products(np.frombuffer(part["q_vectors"], np.int64).reshape(-1, space.size), vectors)
                counts = np.frombuffer(part["counts"], np.int32)
                ids = np.frombuffer(part["ids"], np.int64)
                begin = np.cumsum(counts) - counts
                for row, (query, floor) in enumerate(zip(q_ids.tolist(), floors.tolist())):
                    score = scores[row]
                    # the k + 1 best distinct vectors suffice: one of them may be the query's own, alone
                    least = max(floor, np.partition(score, -k - 1)[-k - 1]) if len(score) > k + 1 else floor
                    best = np.flatnonzero(score >= least)
                    owner = np.repeat(best, counts[best])
                    id_ = ids[np.concatenate([np.arange(begin[j], begin[j] + counts[j]) for j in best])] if len(best) else ids[:0]
                    other = id_ != query
                    id_, value = id_[other], score[owner[other]]
                    top = np.lexsort((id_, -value))[:k]
                    found.append((np.full(len(top), query), id_[top], value[top]))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])
    return run


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.distinct()
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: Column, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``rows (vec_id, embedding)`` where ``queries`` (on ``vec_id``) holds."""
    spark = rows.sparkSession
    vectors = materialize(valid(rows), "vectors")
    space = space_of(vectors, pivots)
    if space is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    keyed = index(vectors, space, k)
    # at most PIVOTS * RINGS rows
    listed = sorted(keyed.groupBy("cell").agg(F.min("radius"), F.max("radius"), F.count(F.lit(1))).collect())
    rings = Directory(*(np.array([r[i] for r in listed]) for i in range(4)))
    salts = F.create_map(*(F.lit(int(x)) for pair in zip(rings.cell, rings.salts) for x in pair))
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("v"), F.element_at(salts, F.col("cell").cast("int"))).cast("bigint"))
    blocks = materialize(
        dealt.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "radius")
        .mapInArrow(_blocks(space), "cell bigint, salt bigint, vectors binary, ids binary, counts binary"), "pivot-blocks")
    asked = vectors.where(queries).distinct()

    def visit(packs: DataFrame) -> DataFrame:
        return packs.join(blocks, ["cell", "salt"]).mapInArrow(_search(space, k), FOUND)

    start = materialize(_best(visit(asked.mapInArrow(_pack(space, rings, True, k), PACK)), k), "first-found")
    floors = start.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("floor"))
    known = asked.join(floors, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", "floor")
    rest = visit(known.mapInArrow(_pack(space, rings, False, k), PACK))
    result = _best(rest.unionByName(start.select("query_id", "vec_id", "score")), k)
    return result.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
