"""Toxicity by non-negative positive-unlabelled learning.

Learned from two bounded samples of the rows that may be learned from: confirmed toxic documents, and documents drawn
from all rows whatever their label, which stand for the unlabelled mixture. With the class prior ``p`` (the toxic
share of all labelled rows that may be learned from), the risk of a linear logistic classifier is
``p * R(positive as toxic) + max(0, R(unlabelled as clean) - p * R(positive as clean))``; where the second term falls
below zero, the step goes back up (the correction of Kiryo et al., 2017). The logistic loss is proper, so
its sigmoid estimates a probability.

A text is the set of its words and their first 3 to 8 letters, hashed. Which features the model
uses is decided by Spark: document frequencies of both samples are aggregated, and the ``FEATURES`` most
telling ones kept. Only the reduced sample rows and the weights reach the driver; both are bounded by the parameters.

Defined cases: null and empty texts have no features and get the score of the bias; without any confirmed toxic row
that may be learned from every score is 0; repeated label rows count as toxic if one of them does; null labels are
no labels; repeated documents are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.frames import held_out, pick, slices
from eventloom.llm.hashing import chosen
from eventloom.llm.words import Recent, split
from eventloom.session import gathered, materialize

#: Bounds of the two training samples, in documents.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 18_000
FEATURES = 2_048
MIN_DOCUMENTS = 4
THRESHOLD = 0.3
STEPS = 300
RATE = 0.05
DECAY = 1e-3
SLICE_BYTES = 2 << 20
#: Sample texts that one task at least describes.
SAMPLE_PER_TASK = 1 << 11
#: Words of each generation that a task remembers features of.
KNOWN_WORDS = 60_000
NOTHING = np.zeros(0, np.int64)
#: Letters of a word's longest start that is a feature of its own, besides the whole word.
LONGEST_START = 8
#: Characters stripped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_…«»„“”"


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word's features; () for a word of marks only."""
    core = word.strip(MARKS).lower()
    if not core:
        return ()
    names = {f"w{core}", *(f"p{core[:n]}" for n in range(3, 1 + min(LONGEST_START, len(core) - 1)))}
    return tuple(sorted(crc32(name.encode()) for name in names))


def document_features(batch: pa.RecordBatch, known: Recent, make) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a document's place in the batch and a feature, in order."""
    places, codes, words = split(batch.column("text"))
    found = known.get(words.tolist(), make)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    table = np.concatenate([np.zeros(0, np.int64), *found])
    starts = np.cumsum(lengths) - lengths
    # a word that a text repeats adds nothing: reduce to distinct words before gathering features
    rows = np.repeat(np.arange(batch.num_rows), np.diff(places))
    used = lengths[codes] > 0
    pairs = np.unique(rows[used] * len(words) + codes[used])
    rows, codes = np.divmod(pairs, max(len(words), 1))
    own = lengths[codes]
    ends = np.cumsum(own)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - own), own)
    pairs = np.unique((np.repeat(rows, own) << 32) + table[index])
    return pairs >> 32, pairs & 0xFFFFFFFF


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Recent(KNOWN_WORDS)
    for whole in batches:
        for batch in slices(whole, limit=SLICE_BYTES):
            rows, found = document_features(batch, known, lambda word: np.array(features(word), np.int64))
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), batch.column("unlabelled"), pa.ListArray.from_arrays(bounds, pa.array(found))],
                ["positive", "unlabelled", "features"])


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def samples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``positive, unlabelled, features`` of the training rows; a row can be of both samples. Copies count once."""
    toxic = pick(labels, "doc_id", "toxic").where((F.col("toxic") == 1) & ~held_out(F.col("doc_id")))
    ids = chosen(toxic.select("doc_id").distinct(), "doc_id", MAX_POSITIVE).select(F.col("doc_id").alias("of"))
    rows = pick(docs, "doc_id", "text").where(~held_out(F.col("doc_id")))
    share = min(1.0, MAX_UNLABELLED / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    # at most MAX_POSITIVE ids, so the broadcast is bounded
    marked = rows.join(F.broadcast(materialize(ids, "toxic-ids")), F.col("doc_id") == F.col("of"), "left").select(
        "text", F.col("of").isNotNull().alias("positive"), drawn.alias("unlabelled"))
    once = marked.where("positive or unlabelled").groupBy(F.xxhash64("text"), "text").agg(
        F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    dealt = gathered(once.select("text", "positive", "unlabelled"), MAX_POSITIVE + MAX_UNLABELLED, SAMPLE_PER_TASK)
    return materialize(dealt.mapInArrow(
        _describe, "positive boolean, unlabelled boolean, features array<bigint>"), "toxic-sample")


def prior(labels: DataFrame) -> float:
    """Toxic share of all labelled documents that may be learned from."""
    known = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    by_doc = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return by_doc.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0


def select(sample: DataFrame, limit: int = FEATURES) -> list[int]:
    """The features whose document frequency differs most between the samples, in standard errors."""
    n_p, n_u = sample.agg(F.sum(F.col("positive").cast("long")), F.sum(F.col("unlabelled").cast("long"))).first()
    counts = sample.select("positive", "unlabelled", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum(F.col("unlabelled").cast("long")).alias("u"))
    a, b = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    telling = F.abs(a - b) / F.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u)
    kept = counts.where(F.col("p") + F.col("u") >= MIN_DOCUMENTS).select("feature", telling.alias("telling"))
    return sorted(r[0] for r in kept.orderBy(F.desc("telling"), "feature").limit(limit).collect())


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, n_features: int,
             p: float) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk; entries ``(rows, cols)`` of a binary matrix, by Adam."""
    n = len(positive)
    wp, wu = positive / max(positive.sum(), 1), unlabelled / max(unlabelled.sum(), 1)
    theta = np.zeros(n_features + 1)
    theta[-1] = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        g = np.bincount(rows, weights=theta[cols], minlength=n) + theta[-1]
        as_toxic = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        clean_loss = np.logaddexp(0, g)
        negative = (wu - p * wp) @ clean_loss
        by_score = (wu - p * wp) * as_toxic
        if negative >= 0:
            by_score = by_score - p * wp * (1 - as_toxic)
        else:
            by_score = -by_score
        grad = np.append(np.bincount(cols, weights=by_score[rows], minlength=n_features), by_score.sum())
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = samples(docs, labels)
    if not sample.where("positive").limit(1).count() or not sample.where("unlabelled").limit(1).count():
        return None
    names = select(sample)
    lookup = F.array_intersect("features", F.lit(names).cast("array<bigint>")) if names else F.array()
    # at most MAX_POSITIVE + MAX_UNLABELLED rows (the latter in expectation) of at most FEATURES numbers
    got = sample.select("positive", "unlabelled", lookup.alias("features")).toArrow().combine_chunks()
    lists = got.column("features").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    cols = np.searchsorted(np.array(names, np.int64), flat)
    positive, unlabelled = (got.column(c).to_numpy().astype(float) for c in ("positive", "unlabelled"))
    weights, bias = fit_nnpu(rows, cols, positive, unlabelled, len(names), min(prior(labels), 0.999))
    return Model({name: w for name, w in zip(names, weights.tolist()) if abs(w) > 1e-6}, bias)


def _score(model: Model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recent(KNOWN_WORDS)
        names = np.array(sorted(model.weights), np.int64)
        values = np.array([model.weights[x] for x in names.tolist()] + [0.0])

        def telling(word: str) -> np.ndarray:
            found = [x for x in features(word) if x in model.weights]
            return np.array(found, np.int64) if found else NOTHING

        for whole in batches:
            for batch in slices(whole, limit=SLICE_BYTES):
                rows, found = document_features(batch, known, telling)
                total = np.bincount(rows, weights=values[np.searchsorted(names, found)], minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))
                kept = [name for name in batch.schema.names if keep_text or name != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(score)], [*kept, "score"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` for every row."""
    named = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    if model is None:
        return named.select("doc_id", F.lit(0.0).alias("score"))
    return named.mapInArrow(_score(model, False), "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    model = train(docs, labels)
    if model is None:
        return docs
    # the score rides along with the whole row: nothing is joined back
    text = docs.columns.index("text")
    wide = docs.toDF(*("text" if i == text else f"__c{i}" for i in range(len(docs.columns))))
    scored = wide.mapInArrow(_score(model, True), T.StructType([*wide.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
