"""Operators with exact results against SQL, brute force or a round trip."""

import ast
import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import connect, rows_of
from eventloom.llm import hilbert_packing, license_zstd, line_spread, mixing, pii, pivot_search, probminhash
from eventloom.llm.components import components
from eventloom.llm.queries import ORACLE, QUERIES
from eventloom.llm.tokens import TOKENIZER, Encoder
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    found = connect(SF).execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())


# --- personal data ----------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("01259.@a-+ ()4x%é\n") for _ in range(rng.randint(0, 50)))
        assert [x[:3] for x in pii.base_spans(text)] == list(plain_spans(text))


IBANS = ("GB82WEST12345698765432", "DE89370400440532013000", "NO9386011117947", "BE68 5390 0754 7034")


@pytest.mark.parametrize("between", [" ", ", ", "\n"])
def test_ibans_in_a_row(between):
    for n in (2, 3, 4):
        for row in itertools.permutations(IBANS, n):
            text = between.join(row)
            assert [text[a:b] for a, b in pii.ibans(text)] == list(row)
    for bad in ("XX82 WEST 1234", "GB00WEST12345698765432", "GB82 WEST 1234"):
        text = f"bank {bad} {IBANS[1]} {bad} {IBANS[0]}"
        assert [text[x["start"]:x["end"]] for x in pii.spans_of(text) if x["kind"] == "iban"] == [IBANS[1], IBANS[0]]


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 200_000, "+1" + "(" * 200_000):
        list(pii.base_spans(text))


@pytest.mark.parametrize("one", ["4111 1111 1111 1111", "bank DE89370400440532013000", "a@b.co", "ssn 123-45-6789"])
def test_a_text_of_many_spans_takes_linear_time(one):
    began = time.perf_counter()
    found = pii.spans_of(", ".join([one] * (1_000_000 // len(one))))
    assert len(found) >= 1_000_000 // len(one) and time.perf_counter() - began < 60


def test_taken_places_equal_a_plain_list():
    rng = random.Random(3)
    for _ in range(500):
        base = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        taken, plain = pii.Taken(base), list(base)
        for _ in range(12):
            start = rng.randrange(60)
            end = start + rng.randint(1, 9)
            free = all(end <= a or b <= start for a, b in plain)
            assert taken.add(start, end) == free
            plain += [(start, end)] * free


def test_digest_equals_plain_spans(spark):
    texts = dict(connect(SF).execute("select doc_id, text from documents").fetchall())
    kinds = list(PATTERNS)
    for r in QUERIES["op2_pii_spans"](spark, SF).collect():
        base = sorted(plain_spans(texts[r["doc_id"]] or ""), key=lambda x: (kinds.index(x[0]), x[1]))
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in kinds] == ([*written] or [])


def test_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [x["kind"] for x in pii.spans_of(text) if not x["base"]]

    assert kinds("bank account DE89 3704 0044 0532 0130 00 THE END") == ["iban"]
    assert kinds("bank account DE88 3704 0044 0532 0130 00") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    assert kinds("card 12 4111111111111111") == ["card_in_run"]


# --- packing ----------------------------------------------------------------

def test_ids_equal_the_tokenizer():
    rng, whole, encoder = random.Random(1), Tokenizer.from_file(TOKENIZER), Encoder()
    bits = ["a", "b", " ", "\n", " ", "\t", "é", "'s", "12", ".", "  ", "<|endoftext|>", "don't ", "日", " ", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    ids, places = encoder.encode(pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert ids[places[i]:places[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert places[-1] == places[-2]


@pytest.mark.parametrize("dimensions, bits", [(2, 5), (3, 3)])
def test_curve_visits_each_cell_and_steps_to_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = hilbert_packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_restore_every_document(spark):
    texts = dict(connect(SF).execute("select doc_id, text from documents").fetchall())
    whole = Tokenizer.from_file(TOKENIZER)
    ids = {k: whole.encode(v or "", add_special_tokens=False).ids + [1] for k, v in texts.items()}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_curve_packing"](spark, SF).collect():
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert (zlib.crc32(part), len(own)) == (r["ids_crc32"], r["doc_tokens"])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]] += range(r["offset"], r["offset"] + r["length"])
    assert all(sorted(covered[k]) == list(range(len(v))) for k, v in ids.items())
    sizes = [len(sequences[k]) for k in sorted(sequences)]
    assert all(sorted(v) == list(range(len(v))) for v in sequences.values())
    assert set(sizes[:-1]) <= {2048} and 0 < sizes[-1] <= 2048


def test_cutting_works_in_a_worker_that_has_not_encoded():
    # as Spark sends them: the function pickled, the rows as a stream; building rows there would load what is missing
    worker = "import pickle, sys, pyarrow; run, rows = pickle.load(sys.stdin.buffer); " \
             "print(*(batch.to_pydict() for batch in run(pyarrow.ipc.open_stream(rows))))"
    ids = np.arange(5, dtype="<u4")
    row = pa.RecordBatch.from_pydict({"doc_id": [7], "at": [2], "doc_tokens": [5], "width": [4], "ids": [ids.tobytes()]})
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), row.schema) as stream:
        stream.write_batch(row)
    sent = cloudpickle.dumps((hilbert_packing._cut(4), sink.getvalue().to_pybytes()))
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", worker], input=sent, capture_output=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": os.pathsep.join([root, *filter(None, sys.path)])})
    assert done.returncode == 0, done.stderr.decode()
    assert ast.literal_eval(done.stdout.decode()) == {
        "doc_id": [7, 7], "start": [0, 2], "length": [2, 3], "ids_crc32": [zlib.crc32(ids[:2]), zlib.crc32(ids[2:])],
        "doc_tokens": [5, 5], "sequence_id": [0, 1], "offset": [2, 0]}


# --- exact search -----------------------------------------------------------

def plain_top(rows, k):
    vectors = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for query, q in vectors:
        if query % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != query)[:k]
            yield from ((query, rank, i, -s) for rank, (s, i) in enumerate(scored, 1))


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(pivot_search, "FIRST_VECTORS", 16)
    rng = np.random.default_rng(6)
    n = 600
    if kind == "spread":
        x = rng.normal(size=(n, 6)).astype(np.float32)
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, 3)).astype(np.float32)
        x[::3] = 0.5
    else:
        x = (rng.normal(size=(8, 6))[rng.integers(8, size=n)] * 5 + rng.normal(size=(n, 6)) * 0.05).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = pivot_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_top(rows, 10))


def test_far_rings_are_skipped():
    space = pivot_search.Space(1, 100.0, np.array([[0.0, 10.0], [10.0, 0.0]]))
    rings = pivot_search.Directory(np.array([0, 16]), np.array([0.0, 1.0]), np.array([2.0, 3.0]), np.array([5, 5]))
    bounds = rings.bounds(space.distances(np.array([[8.0, 0.0]])))
    assert bounds[0, 1] == 0 and bounds[0, 0] > 8


# --- near duplicates --------------------------------------------------------

def shingle_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a.keys() & b.keys())


def test_similarity_equals_its_definition():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (Counter(rng.choice(range(12)) for _ in range(rng.randint(0, 14))) for _ in range(2))
        sets = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int64)) for c in (a, b)]
        assert probminhash.probability_jaccard(*sets) == pytest.approx(plain_similarity(a, b))


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(8)
    elements = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    weights = rng.integers(1, 6, 400)
    for shared in (100, 300, 360):
        a = (np.sort(elements[:380]), weights[:380])
        other = np.concatenate([elements[:shared], rng.integers(1, 1 << 60, 400 - shared).astype(np.uint64)])
        order = np.argsort(other)
        b = (other[order], weights[order])
        first = np.argsort(elements[:380])
        a = (elements[:380][first], weights[:380][first])
        got = probminhash.signatures([a, b], 4096)
        assert (got[0] == got[1]).mean() == pytest.approx(probminhash.probability_jaccard(a, b), abs=0.04)


def classes_of(rows):
    counts = {i: shingle_counts(t) for i, t in rows}
    root = {i: i for i in counts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(counts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if plain_similarity(counts[a], counts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [cases.prose(100 + i, 120).split() for i in range(6)]
    rows = []
    for i in range(90):
        words = list(texts[i % 6])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    # a chain: neighbours are similar, its ends are not
    chain = [f"c{k}" for k in range(150)]
    rows += [(200 + i, " ".join(chain[4 * i:4 * i + 100])) for i in range(10)]
    rows += [(300, ""), (301, None), (302, "two words"), (303, "two  words"), (304, "two other")]
    frame = cases.docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(frame).collect()}
    assert got == classes_of(rows)
    kept = probminhash.without_near_duplicates(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_contents_of_one_band_are_linked_without_its_leader(spark, monkeypatch):
    """All contents share every band; the smallest is similar to none, two others are to each other."""
    monkeypatch.setattr(probminhash, "band_hashes", lambda s: np.tile(np.arange(probminhash.BANDS), (len(s), 1)))
    base = [f"x{k}" for k in range(60)]
    for trial in range(3):
        rows = [(i, f"alone{trial}{i} " + cases.prose(1000 * trial + i, 30)) for i in range(6)]
        rows += [(10 + j, " ".join([*base, f"end{trial}{j}"])) for j in range(3)]
        frame = cases.docs(spark, [(i, t, "en", "s") for i, t in rows])
        assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(frame).collect()} == classes_of(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}


# --- lines, mixing, licenses ------------------------------------------------

def test_boilerplate_goes_but_for_its_first_place(spark):
    rows = [(i, f"own line {i}\n  shared banner\t\nrest {i}\n", "en", f"site{i % 6}") for i in range(12)]
    rows += [(50 + i, "local banner\nmore", "en", f"site{i % 4}") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_spread.without_boilerplate(cases.docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[7] == "own line 7\nrest 7\n"
    assert all(got[50 + i] == "local banner\nmore" for i in range(40))


@pytest.mark.parametrize("registers", [4, 10])
def test_near_threshold_lines_are_counted_exactly(spark, registers):
    rows = [(100 * k + i, f"banner {k}", "en", f"s{i}") for k in range(1, 30) for i in range(k)]
    frame = cases.docs(spark, rows)
    lost = [r["doc_id"] // 100 for r in line_spread.without_boilerplate(frame, min_sites=12, log_registers=registers).collect()
            if not r["text"]]
    assert Counter(lost) == {k: k - 1 for k in range(12, 30)}


def test_empty_and_null_sources_are_sites(spark):
    rows = [(10 * k + i, f"banner {k}", "en", s) for k, sites in enumerate((["", *"abcd"], [None, *"abcd"], ["", None, *"abc"], ["", *"abc"]))
            for i, s in enumerate(sites)]
    lost = Counter(r["doc_id"] // 10 for r in line_spread.without_boilerplate(cases.docs(spark, rows)).collect() if not r["text"])
    assert lost == {0: 4, 1: 4, 2: 4}


def test_mixed_rows_hold_the_words_taken(spark):
    rng = random.Random(11)
    rows = [(i, cases.prose(i, rng.randint(1, 60)), "en", rng.choice("aaaabcd")) for i in range(120)]
    frame = cases.docs(spark, rows)
    taken = {r["doc_id"]: r for r in mixing.mix(frame, range_rows=7).collect()}
    mixed = Counter()
    for r in mixing.mixed_documents(frame, range_rows=7).collect():
        mixed[r["doc_id"]] += len(r["text"].split())
        assert dict((i, t) for i, t, _, _ in rows)[r["doc_id"]].startswith(r["text"])
    assert mixed == Counter({i: r["taken"] for i, r in taken.items() if r["taken"]})
    by_source = defaultdict(int)
    for i, _, _, source in rows:
        by_source[source] += taken[i]["taken"]
    targets = {rows[i][3]: r["target"] for i, r in taken.items()}
    assert all(int(targets[s]) == by_source[s] for s in by_source)


def test_targets_fill_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 990, 1), (None, 0, 1)], "source string, source_size bigint, n_rows bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5: a is capped at 30, the rest share 1970 by 2 : 1, and the empty last source takes nothing
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(1970 * 2 / 3) and got["c"] == pytest.approx(1970 / 3)


def test_licenses_and_their_differences():
    scanner = license_zstd.Scanner()
    altered = license_zstd.TEMPLATES["mit"].replace("free of charge", "at no cost").replace(", to any", ",\nto any")
    found = scanner.scan(f"foo\nCopyright 2020 X\n{altered}\nThe end. All rights reserved.\n" + "pad liability\n" * 4000 + "Released under the MIT License.")
    assert [x["license"] for x in found] == ["mit", "all-rights-reserved", "mit-notice"]
    assert found[0]["missing"] == ["free", "of", "charge"] and found[0]["added"] == ["at", "no", "cost"]
    assert scanner.scan("a license to drive\nwithout any reserved seats, permission or warranty") == []
    twice = "All rights reserved.\n\n\n\n\nwords\n\n\n\nall Rights reserved"
    assert [(x["start"], x["end"]) for x in scanner.scan(twice)] == [(0, 19), (len(twice) - 19, len(twice))]


@pytest.mark.parametrize("size", [2_000, 8_000, 16_000, 100_000])
def test_licenses_inside_long_lines(size):
    scanner, rng = license_zstd.Scanner(), random.Random(size)
    for name, text in license_zstd.TEMPLATES.items():
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(size // 6)]
        half = len(words) // 2
        line = " ".join([*words[:half], text, *words[half:]])
        at = line.index(text)
        found = scanner.scan(line)
        assert [(x["license"], x["start"], x["missing"], x["added"]) for x in found] == [(name, at, [], [])]
        assert found[0]["end"] - at >= len(text) - 1


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_licenses(mark, width):
    scanner = license_zstd.Scanner()
    for name, text in license_zstd.TEMPLATES.items():
        wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))
        gapped = wrapped.replace("conditions:", f"conditions:\n{mark.rstrip()}\n{mark.rstrip()}\n{mark.rstrip()}")
        for form in (wrapped, gapped):
            found = scanner.scan(f"int x;\n{form}\nint y;\n" + "plain line\n" * 50)
            assert [(x["license"], x["missing"]) for x in found] == [(name, [])]
            assert found[0]["added"] == []


def test_notices_across_pieces(monkeypatch):
    monkeypatch.setattr(license_zstd, "PIECE_WORDS", 50)
    scanner = license_zstd.Scanner()
    for pad in range(0, 200, 7):
        text = "word " * pad + license_zstd.TEMPLATES["mit"] + " word" * 300
        assert [(x["license"], x["start"], x["missing"], x["added"]) for x in scanner.scan(text)] == [("mit", 5 * pad, [], [])]


def plain_licenses(scanner, text):
    """Every window of every template over the whole text, compressed; the largest saving that aligns takes its place."""
    spans = [m.span() for m in license_zstd.WORDS.finditer(text)]
    words, ranked, taken = [text[a:b].lower() for a, b in spans], [], []
    for k, t in enumerate(scanner.templates):
        for start in range(0, len(words), t.step):
            saved = scanner.saved(k, words[start:start + t.width])
            if saved >= license_zstd.MIN_SAVING * scanner.own[k]:
                ranked.append((-saved, start, k))
    for _, start, k in sorted(ranked):
        t = scanner.templates[k]
        near = max(0, start - t.step)
        place = t.align(words[near:start + t.width + t.step])
        if place:
            begin, end = spans[near + place[0]][0], spans[near + place[1] - 1][1]
            if all(end <= a or b <= begin for a, b, *_ in taken):
                taken.append((begin, end, scanner.templates[k].name, len(place[2]), len(place[3])))
    return sorted(taken)


def licensed_texts():
    rng, texts = random.Random(2), [t for t, in connect("/root/testdata/sf0.01").execute(
        "select text from documents where regexp_matches(text, '(?i)licen[sc]|reserved')").fetchall()]
    for name, text in license_zstd.TEMPLATES.items():
        words = text.split()
        for _ in range(3):
            altered = [w if rng.random() > 0.04 else rng.choice(["foreign", "", "very " + w]) for w in words]
            texts.append(f"{cases.prose(len(name), 30)} {' '.join(altered)} {cases.prose(3, 30)} All rights reserved. {text}")
    return texts


def test_license_query_equals_all_windows_and_templates(spark, monkeypatch):
    monkeypatch.setattr(license_zstd, "PIECE_WORDS", 300)
    scanner, texts = license_zstd.Scanner(), licensed_texts()
    assert len(texts) > 60
    for text in texts:
        got = [(x["start"], x["end"], x["license"], len(x["missing"]), len(x["added"])) for x in scanner.scan(text)]
        assert got == plain_licenses(scanner, text)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    found = license_zstd.digest(license_zstd.scan_licenses(cases.docs(spark, rows))).collect()
    for r in found:
        want = ",".join(f"{name}:{a}:{b}:{m}:{n}" for a, b, name, m, n in plain_licenses(scanner, texts[r["doc_id"]]))
        assert r["licenses"] == want


def test_savings_decide_which_license_is_found(monkeypatch):
    texts = licensed_texts()
    by_saving = [license_zstd.Scanner().scan(t) for t in texts]
    scanner = license_zstd.Scanner()
    monkeypatch.setattr(scanner, "saved", lambda k, words: 10_000)
    constant = [scanner.scan(t) for t in texts]
    assert sum([(x["license"], x["start"], x["end"]) for x in a] != [(x["license"], x["start"], x["end"]) for x in b]
               for a, b in zip(by_saving, constant)) > len(texts) // 4


def test_many_notices_in_one_text_take_linear_time():
    assert len(license_zstd.Scanner().scan("All rights reserved. " * 8_000)) == 8_000
