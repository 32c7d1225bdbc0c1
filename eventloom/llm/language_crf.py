"""Language of a text from a linear-chain conditional random field over its words.

Each word's labels are scored by hashed features (character n-grams within word boundaries, starts and ends of up
to three letters, membership in a learned lexicon); learned transitions tie neighbouring words together, so short or
foreign words follow their surroundings and switches of language within a text cost something. Forward-backward gives
each word's marginal probabilities; a text's language is the one with the largest sum over its words with a letter,
its score that language's share.

Training sees a bounded sample: up to ``DOCS_PER_LANGUAGE`` documents of each language that may be learned from, one
window of up to ``WINDOW_WORDS`` words of each. Training sequences are spliced from pieces of these windows, so
switches are seen too. The model (a weight table and the transitions) is small and sent with the tasks.

Long texts: the recursion runs over blocks of words. Products of transfer matrices carry it from block to block, so
all blocks of many texts advance together; nothing is cut off and results equal those of the plain recursion.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled row that may be learned
from, every text is; repeated rows are predicted alike; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.frames import WORD, held_out, pick, slices
from eventloom.llm.words import split
from eventloom.session import materialize

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 500
WINDOW_WORDS = 400
HASH_BITS = 18
LEXICON_COUNT = 3
SEQUENCES = 3_000
SEQUENCE_WORDS = 64
PIECE_WORDS = (6, 48)
STEPS = 60
RATE = 0.08
DECAY = 1e-6
SEED = 11
BLOCK = 64
SLICE_BYTES = 4 << 20
MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_…«»„“”0123456789"
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Features of distinct words: entry ``i`` says that word ``owner[i]`` has ``feature[i]``."""

    owner: np.ndarray
    feature: np.ndarray
    whole: np.ndarray
    lettered: np.ndarray


def describe(words: np.ndarray, lexicon: np.ndarray | None) -> Words:
    """Features of words; those in ``lexicon`` (sorted hashes) get one of their own."""
    raw = pa.array(words, pa.string())
    lettered = pc.match_substring_regex(raw, r"\p{L}").to_numpy(zero_copy_only=False)
    bare = pc.utf8_trim(pc.utf8_lower(raw), MARKS)
    bounded = "\x02" + "\x03\x02".join(bare.to_numpy(zero_copy_only=False)) + "\x03" if len(words) else ""
    points = np.frombuffer(bounded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.flatnonzero(points == 2)
    # a control character inside a word would shift the words behind it
    if len(begin) != len(words):
        clean = [w.replace("\x02", " ").replace("\x03", " ") for w in bare.to_pylist()]
        points = np.frombuffer(("\x02" + "\x03\x02".join(clean) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.flatnonzero(points == 2)
    n = len(points)
    of = np.zeros(n, np.int64)
    of[begin] = 1
    of = np.cumsum(of) - 1
    within = np.arange(n) - begin[of] if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    owners, features = [], []

    def grams(width: int, kind: int, where: np.ndarray | None) -> None:
        start = np.arange(n - width + 1) if where is None else where
        start = start[start + width <= n]
        start = start[of[start] == of[start + width - 1]]
        total = np.full(len(start), kind, np.uint64)
        for i in range(width):
            total = _scatter(total * FACTORS[0] + points[start + i] + np.uint64(1))
        owners.append(of[start])
        features.append(total)

    grams(2, 1, None)
    grams(3, 2, None)
    grams(4, 3, begin)  # the boundary and three letters
    grams(4, 4, begin + size - 4 if n else begin)
    owners[-1], features[-1] = owners[-1][size[owners[-1]] >= 4], features[-1][size[owners[-1]] >= 4]
    whole = np.zeros(len(words), np.uint64)
    if n:
        weighted = _scatter((points + np.uint64(7)) * FACTORS[1] + within.astype(np.uint64) * FACTORS[2])
        whole = _scatter(np.add.reduceat(weighted, begin))
    if lexicon is not None and len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == whole)
        owners.append(known)
        features.append(_scatter(whole[known] * FACTORS[3]))
    owner = np.concatenate(owners)
    feature = (np.concatenate(features) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return Words(owner, feature, whole, lettered)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features by languages
    transitions: np.ndarray  # log weights, from by to
    lexicon: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        n = len(words.lettered)
        return np.stack([np.bincount(words.owner, weights=self.weights[words.feature, k], minlength=n)
                         for k in range(len(self.languages))], axis=1)


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginal_sums(scores: np.ndarray, codes: np.ndarray, places: np.ndarray, counted: np.ndarray,
                  transitions: np.ndarray) -> np.ndarray:
    """Per text, the sums of the marginal probabilities of its counted words.

    ``scores`` and ``counted`` are per distinct word, texts are ``codes[places[i]:places[i + 1]]``. Each text starts
    from the uniform distribution before its first word.
    """
    k, n = scores.shape[1], len(places) - 1
    step = np.exp(transitions - transitions.max())
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    lengths = np.diff(places)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros((n, k))
    owner = np.repeat(np.arange(n), blocks)
    number = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = places[:-1][owner] + number * BLOCK
    size = np.minimum(BLOCK, places[1:][owner] - begin)
    # longest blocks first: those that have a word at offset t are then a leading part
    order = np.argsort(-size, kind="stable")
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    begin, size = begin[order], size[order]
    going = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks with size > t
    longest = int(size[0])

    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(longest):
        m = going[t]
        now = (transfer[:m].reshape(-1, k) @ step).reshape(m, k, k) * weight[codes[begin[:m] + t]][:, None, :]
        transfer[:m] = now / now.sum(axis=(1, 2), keepdims=True)

    first = np.cumsum(blocks) - blocks
    enter, leave = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    for j in range(1, int(blocks.max())):
        here = first[blocks > j] + j
        enter[rank[here]] = _norm(np.einsum("ni,nij->nj", enter[rank[here - 1]], transfer[rank[here - 1]]))
    for j in range(int(blocks.max()) - 2, -1, -1):
        here = first[blocks > j + 1] + j
        leave[rank[here]] = _norm(np.einsum("nij,nj->ni", transfer[rank[here + 1]], leave[rank[here + 1]]))

    forward = np.zeros((longest, total, k))
    alpha = enter
    for t in range(longest):
        m = going[t]
        alpha = _norm((alpha[:m] @ step) * weight[codes[begin[:m] + t]])
        forward[t, :m] = alpha
    sums = np.zeros((total, k))
    beta = leave
    for t in range(longest - 1, -1, -1):
        m = going[t]
        word = codes[begin[:m] + t]
        sums[:m] += _norm(forward[t, :m] * beta[:m]) * counted[word][:, None]
        beta[:m] = _norm((weight[word] * beta[:m]) @ step.T)
    by_text = np.zeros((n, k))
    np.add.at(by_text, owner[order], sums)
    return by_text


def _splice(windows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences of word codes with labels, spliced from pieces of random windows; languages come evenly."""
    by_label = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    words = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    truth = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    for row in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            window = rng.choice(by_label[rng.integers(len(by_label))])
            source = windows[window]
            length = min(int(rng.integers(*PIECE_WORDS)), len(source), SEQUENCE_WORDS - at)
            start = int(rng.integers(len(source) - length + 1))
            words[row, at:at + length] = source[start:start + length]
            truth[row, at:at + length] = labels[window]
            at += length
    return words, truth


def fit(languages: list[str], windows: list[np.ndarray], labels: np.ndarray, vocabulary: np.ndarray) -> Model:
    """Maximum likelihood by Adam on spliced sequences; ``windows`` hold codes into ``vocabulary``."""
    rng = np.random.default_rng(SEED)
    counts = np.bincount(np.concatenate(windows), minlength=len(vocabulary))
    plain = describe(vocabulary, None)
    lexicon = np.unique(plain.whole[(counts >= LEXICON_COUNT) & plain.lettered])
    words, k = describe(vocabulary, lexicon), len(languages)
    model = Model(languages, np.zeros((1 << HASH_BITS, k)), np.zeros((k, k)), lexicon)
    codes, truth = _splice(windows, labels, rng)
    used, codes = np.unique(codes, return_inverse=True)
    codes = codes.reshape(truth.shape)
    wanted = np.isin(words.owner, used)
    renumber = np.zeros(len(vocabulary), np.int64)
    renumber[used] = np.arange(len(used))
    words = Words(renumber[words.owner[wanted]], words.feature[wanted], words.whole[used], words.lettered[used])
    n, length = codes.shape
    onehot = np.eye(k)[truth]
    seen = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights),
               np.zeros_like(model.transitions), np.zeros_like(model.transitions)]
    for i in range(1, STEPS + 1):
        scores = model.emissions(words)
        weight = np.exp(scores - scores.max(axis=1, keepdims=True))[codes]
        step = np.exp(model.transitions - model.transitions.max())
        forward = np.zeros((length, n, k))
        alpha = np.full((n, k), 1.0 / k)
        for t in range(length):
            forward[t] = alpha = _norm((alpha @ step) * weight[:, t])
        gamma = np.zeros((n, length, k))
        pairs = np.zeros((k, k))
        beta = np.ones((n, k))
        for t in range(length - 1, -1, -1):
            gamma[:, t] = _norm(forward[t] * beta)
            ahead = weight[:, t] * beta
            if t:
                joint = forward[t - 1][:, :, None] * step[None] * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta = _norm(ahead @ step.T)
        excess = (gamma - onehot).reshape(-1, k) / n
        by_word = np.stack([np.bincount(codes.reshape(-1), weights=excess[:, j], minlength=len(used)) for j in range(k)], 1)
        grad = np.stack([np.bincount(words.feature, weights=by_word[words.owner, j], minlength=1 << HASH_BITS)
                         for j in range(k)], axis=1) + DECAY * model.weights
        for value, g, m, v in ((model.weights, grad, *moments[:2]), (model.transitions, (pairs - seen) / n, *moments[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= RATE * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame) -> Model | None:
    named = pick(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = (F.xxhash64(F.lit("language"), "doc_id", "text"),)
    ids = named.select("lang", F.xxhash64("doc_id", "text").alias("of"), order[0].alias("draw"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "of")))
    # bounded by DOCS_PER_LANGUAGE for each language
    some = materialize(ranked.where(F.col("rank") <= DOCS_PER_LANGUAGE).select("of"), "language-ids")
    rows = named.join(F.broadcast(some), F.xxhash64("doc_id", "text") == F.col("of"), "left_semi")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    spare = F.greatest(F.lit(1), F.size("words") - WINDOW_WORDS + 1)
    window = F.slice("words", (F.pmod(F.xxhash64("doc_id"), spare) + 1).cast("int"), F.lit(WINDOW_WORDS))
    got = rows.select("doc_id", "lang", words.alias("words")).where(F.size("words") > 0).select(
        "lang", window.alias("words")).dropDuplicates().orderBy("lang", "words").toArrow()
    if not got.num_rows:
        return None
    languages = sorted(set(got.column("lang").to_pylist()))
    labels = np.searchsorted(np.array(languages), np.array(got.column("lang").to_pylist()))
    lists = got.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    places = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    codes = coded.indices.to_numpy().astype(np.int64)
    windows = [codes[a:b] for a, b in zip(places[:-1], places[1:])]
    return fit(languages, windows, labels, coded.dictionary.to_numpy(zero_copy_only=False))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE_BYTES):
                places, codes, distinct = split(batch.column("text"))
                words = describe(distinct, model.lexicon)
                sums = marginal_sums(model.emissions(words), codes, places, words.lettered.astype(float), model.transitions)
                total = sums.sum(axis=1)
                best = sums.argmax(axis=1)
                names = np.array([*model.languages, UNKNOWN], object)
                known = total > 0
                score = np.where(known, sums.max(axis=1) / np.where(known, total, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names[np.where(known, best, len(model.languages))], pa.string()),
                     pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``)."""
    model = train(docs)
    named = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    if model is None:
        found = named.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = named.mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
