"""Quality rules learned as a decision list over text statistics, in DataFrame expressions only.

Statistics come from built-in array and string functions inside each row, so scoring a corpus is one map over it.
Sequential covering learns the list from labelled statistics: a rule is a conjunction of thresholds, grown by
information gain against the rows no earlier rule caught, pruned on rows set aside, and accepted only if it is
precise there. The list becomes one ordered ``CASE`` expression whose first match rejects a document.

Only the statistics of at most ``MAX_LABELLED`` labelled rows reach the driver.

Defined cases: a null text has no words (it fails the base rule, as does an empty one); without labels of both kinds the
list is empty and the base rule alone decides; a document labelled more than once counts with its lowest label; null
labels are no labels; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import held_out, pick
from eventloom.llm.hashing import chosen
from eventloom.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: Bound of the training sample, in labelled documents.
MAX_LABELLED = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 64
MIN_PRECISION = 0.9
MIN_CAUGHT = 5

MEASURES = ("n_words", "chars_per_word", "symbol_rate", "repeated_line_rate", "repeated_word_rate", "distinct_rate",
            "upper_rate", "mark_rate", "digit_rate", "words_per_line")


def _long(column: Column) -> Column:
    return column.cast("bigint")


def _repeats(ordered: Column) -> Column:
    """Positions, in order, of the windows that equal a neighbour in the order of hashes."""
    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.get(ordered, other)["h"] == x["h"], F.lit(False))

    return F.array_sort(F.transform(
        F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words inside the windows at these positions: each covers five, or as many as lie before the next."""
    each = F.transform(places, lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pick(docs, "doc_id", "text").select("doc_id", text.alias("__text"))
    cut = base.select(
        "doc_id", "__text", F.filter(F.split("__text", BLANKS, -1), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(TRIMMED)) != "").alias("__lines"))
    hashed = cut.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    hashes = F.col("__hashes")
    # get() counts from 0; five neighbouring word hashes make a window's hash
    starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(0), F.size(hashes) - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    windowed = hashed.select(
        "doc_id", "__text", "__lines", F.size("__words").alias("n_words"),
        F.char_length(F.array_join("__words", "")).alias("word_chars"),
        F.size(F.array_distinct(hashes)).alias("n_distinct"),
        F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))).alias("__windows"))
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # texts without a repeated window, nearly all, skip the sort
    sorted_ = windowed.withColumn("__ordered", F.when(some, ordered).otherwise(none)).drop("__windows")
    placed = sorted_.withColumn("__places", _repeats(F.col("__ordered"))).drop("__ordered")
    return placed.select(
        "doc_id", _long(F.col("n_words")).alias("n_words"), _long(F.col("word_chars")).alias("word_chars"),
        _long(F.regexp_count("__text", F.lit(SYMBOLS))).alias("n_symbols"),
        _long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _long(_covered(F.col("__places"))).alias("n_repeat_words"),
        _long(F.col("n_distinct")).alias("n_distinct"), _long(F.size("__lines")).alias("n_lines"),
        _long(F.regexp_count("__text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        _long(F.regexp_count("__text", F.lit("[!?]"))).alias("n_marks"),
        _long(F.regexp_count("__text", F.lit("[0-9]"))).alias("n_digits"))


def measures() -> dict[str, Column]:
    """What rules set thresholds on: the counts of ``statistics`` as rates."""
    def rate(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    made = (F.col("n_words").cast("double"), rate("word_chars", "n_words"), rate("n_symbols", "word_chars"),
            rate("n_dup_lines", "n_lines"), rate("n_repeat_words", "n_words"), rate("n_distinct", "n_words"),
            rate("n_upper", "word_chars"), rate("n_marks", "word_chars"), rate("n_digits", "word_chars"),
            rate("n_words", "n_lines"))
    return dict(zip(MEASURES, made))


@dataclass(frozen=True)
class Condition:
    measure: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.measure] > self.cut if self.above else x[:, self.measure] <= self.cut

    def column(self, made: dict[str, Column]) -> Column:
        value = made[MEASURES[self.measure]]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{MEASURES[self.measure]} {'>' if self.above else '<='} {self.cut:.4g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for condition in rule:
        hit &= condition.holds(x)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of largest gain until only bad rows are left."""
    rule: Rule = ()
    hit = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best, best_gain = None, 1e-9
        for m in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[hit, m], np.linspace(0, 1, CUTS + 1))):
                for above in (True, False):
                    condition = Condition(m, above, float(cut))
                    now = hit & condition.holds(x)
                    p = (now & bad).sum()
                    if p < MIN_CAUGHT:
                        continue
                    n = now.sum() - p
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain = condition, gain
        if best is None:
            break
        rule = (*rule, best)
        hit &= best.holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = _all(rule, x)
    p = (hit & bad).sum()
    return (2.0 * p - hit.sum()) / max(hit.sum(), 1)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last conditions as long as that does not lower the worth on rows set aside."""
    best = rule
    for length in range(len(rule) - 1, 0, -1):
        if _worth(rule[:length], x, bad) >= _worth(best, x, bad):
            best = rule[:length]
    return best


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that catch bad rows, from measures (rows by ``MEASURES``)."""
    aside = np.random.default_rng(seed).permutation(len(x)) % 3 == 0
    rules: list[Rule] = []
    open_ = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        grow, check = open_ & ~aside, open_ & aside
        if (bad & grow).sum() < MIN_CAUGHT or not (~bad & grow).any():
            break
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule = _prune(rule, x[check], bad[check])
        caught = _all(rule, x) & open_
        aside_caught = caught & aside
        # precise on the rows set aside, with a pseudo-count of one good row against chance
        p = (aside_caught & bad).sum()
        if p < 2 or p / (aside_caught.sum() + 0.1) < MIN_PRECISION:
            break
        rules.append(rule)
        open_ &= ~caught
    return rules


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Measures and badness of at most ``MAX_LABELLED`` labelled documents that may be learned from."""
    known = pick(labels, "doc_id", "quality").where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most MAX_LABELLED rows of two numbers, so the broadcast is bounded
    some = materialize(chosen(known, "doc_id", MAX_LABELLED).select(F.col("doc_id").alias("of"), "quality"), "quality-ids")
    rows = pick(docs, "doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of"))
    quality = F.col("quality").cast("double")
    # a number in place of the id brings the label through the statistics
    made = statistics(rows.select(quality.alias("doc_id"), "text"))
    drawn = made.select("doc_id", *(c.alias(n) for n, c in measures().items()))
    # an id may stand on any number of rows: the rows that come to the driver are bounded as well
    drawn = drawn.orderBy(F.xxhash64(F.lit("rows"), "doc_id", *MEASURES), "doc_id", *MEASURES).limit(MAX_LABELLED)
    got = drawn.orderBy("doc_id", *MEASURES).collect()
    table = np.array([tuple(r) for r in got], float).reshape(len(got), 1 + len(MEASURES))
    return table[:, 1:], table[:, 0] == 0


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that matches, from 1; null where none does."""
    made = measures()
    out = None
    for number, rule in enumerate(rules, 1):
        match = F.lit(True)
        for condition in rule:
            match = match & condition.column(made)
        out = F.when(match, number) if out is None else out.when(match, number)
    return F.lit(None).cast("int") if out is None else out


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, the base verdict, and whether a document is kept; ``rule`` is the learned rule that rejects it."""
    rules = learn(*labelled(docs, labels))
    counted = statistics(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
