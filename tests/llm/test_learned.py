"""Models against brute force, and their accuracy on held-out rows."""

import itertools
import zlib

import numpy as np
import pytest

from checks.compare import connect
from eventloom.llm import language_crf, quality_rules, toxicity_pu
from eventloom.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(language_crf, "BLOCK", 3)
    rng = np.random.default_rng(1)
    k, lengths = 3, [0, 1, 2, 3, 4, 7, 8]
    places = np.concatenate([[0], np.cumsum(lengths)])
    scores, transitions = rng.normal(size=(5, k)), rng.normal(size=(k, k))
    codes, counted = rng.integers(5, size=places[-1]), np.array([1.0, 1.0, 0.0, 1.0, 1.0])
    got = language_crf.marginal_sums(scores, codes, places, counted, transitions)
    step = np.exp(transitions)
    for i, n in enumerate(lengths):
        word = codes[places[i]:places[i + 1]]
        want, total = np.zeros(k), 0.0
        for path in itertools.product(range(k), repeat=n):
            p = 1.0
            for t, label in enumerate(path):
                p *= (step[path[t - 1], label] if t else step[:, label].mean()) * np.exp(scores[word[t], label])
            total += p
            for t, label in enumerate(path):
                want[label] += p * counted[word[t]]
        np.testing.assert_allclose(got[i], want / total if n else 0.0, atol=1e-9)


def test_control_characters_in_words_shift_nothing():
    words = np.array(["ab", "a\x02b", "cd\x03", "ef"], object)
    plain, odd = language_crf.describe(np.array(["ef"], object), None), language_crf.describe(words, None)
    assert sorted(odd.feature[odd.owner == 3]) == sorted(plain.feature)


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_crf"](spark, SF).collect()}
    truth = connect(SF).execute("select doc_id, lang from documents where lang is not null").fetchall()
    held = [(got[i]["lang_pred"], lang) for i, lang in truth if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_code_switched_words_and_of_none(spark):
    rows = [(i, "the house and the garden are green " * 5, "en", "s") for i in range(40)]
    rows += [(100 + i, "das haus und der garten sind schön grün " * 5, "de", "s") for i in range(40)]
    rows += [(998, None, None, "s"), (999, "12 34 --", None, "s"), (1000, "der garten und das haus the house", None, "s")]
    got = {r["doc_id"]: r for r in language_crf.identify(cases.docs(spark, rows)).collect()}
    assert got[998]["lang_pred"] == got[999]["lang_pred"] == "und"
    assert got[1000]["lang_pred"] == "de" and 0.5 < got[1000]["score"] < 1


def test_risk_correction_finds_the_positives():
    rng = np.random.default_rng(2)
    n = 4000
    truth = rng.random(n) < 0.2
    marked = rng.random((n, 6)) < np.where(truth[:, None], [0.6] * 3 + [0.3] * 3, [0.02] * 3 + [0.3] * 3)
    rows, cols = np.nonzero(marked)
    positive = (truth & (rng.random(n) < 0.5)).astype(float)
    weights, bias = toxicity_pu.fit_nnpu(rows, cols, positive, np.ones(n), 6, 0.2)
    predicted = marked @ weights + bias > 0
    assert (predicted == truth).mean() > 0.93
    assert abs(1 / (1 + np.exp(-(marked @ weights + bias)))).mean() < 0.35


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity_nnpu"](spark, sf).collect()}
    rows = connect(sf).execute("select doc_id, toxic from labels").fetchall()
    held = [(got[i]["predicted"], y) for i, y in rows if got[i]["held_out"]]
    assert sum(p for p, y in held if y) >= 0.85 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.04 * sum(1 - y for _, y in held)


def test_decision_list_recovers_thresholds():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality_rules.MEASURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 0] < 0.5)) | (x[:, 6] > 0.9)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality_rules._all(rule, x)
    assert (hit == bad).mean() > 0.98 and len(rules) <= 6


def test_no_rule_from_noise():
    rng = np.random.default_rng(4)
    assert quality_rules.learn(rng.random((400, 10)), rng.random(400) < 0.1) == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_quality_counts_equal_plain_python(spark, sf):
    import re
    from collections import Counter

    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, sf).collect()}
    for doc_id, text in connect(sf).execute("select doc_id, text from documents").fetchall():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_rows_on_the_driver_are_bounded_for_a_hot_id(spark, monkeypatch):
    """One labelled id on many different texts: no more rows are learned from than the bound."""
    monkeypatch.setattr(quality_rules, "MAX_LABELLED", 10)
    hot = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = cases.docs(spark, [(hot, cases.prose(i), "en", "s") for i in range(300)] + [(None, cases.prose(i), "en", "s") for i in range(9)])
    x, bad = quality_rules.labelled(docs, cases.labels(spark, [(hot, 0, 0, "e"), (None, 1, 0, "e")]))
    assert len(x) == len(bad) == 10 and bad.all()


def test_quality_plan_is_native(spark):
    plan = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan
