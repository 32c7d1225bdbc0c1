"""PPM scores, token alignment and fill-in-the-middle against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import connect
from eventloom.llm import fill_middle, merge_path, ppm
from eventloom.llm.queries import QUERIES
from eventloom.llm.token_pairs import PairEncoder
from tests.llm import cases

SF = "/root/testdata/sf0.001"
BITS = ["a", "the ", "  ", " ", "\n", " ", "\t", "é", "'s", "12", ".", "<|endoftext|>", "don't ", "日", "▁", "\x85", "\xa0", "\x00",
        "<s>", "<0x41>", "word", "\U0001F600"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def documents():
    return connect(SF).execute("select doc_id, text from documents").fetchall()


# --- prediction by partial matching ------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learns(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def plain_ppm(docs, order):
    """Every context as a dict of counts, symbol by symbol."""
    tree = defaultdict(Counter)

    def symbols(text):
        return [255] * order + list((text or "").translate(LOWER).encode()) + [254]

    for doc_id, text in docs:
        s = symbols(text)
        for p in range(order, len(s) if learns(doc_id) else 0):
            for k in range(order + 1):
                tree[tuple(s[p - k:p])][s[p]] += 1
    for doc_id, text in docs:
        s, total = symbols(text), 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                own = {a: n for a, n in tree.get(tuple(s[p - k:p]), {}).items() if a not in gone}
                if s[p] in own:
                    total += math.log10((own[s[p]] - 0.5) / sum(own.values()))
                    break
                if own:
                    total += math.log10(len(own) / 2 / sum(own.values()))
                    gone |= set(own)
            else:
                total += math.log10(1 / (255 - len(gone)))
        yield total


def plain_base(docs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""] for _, text in docs]
    count = Counter(w for (doc_id, _), own in zip(docs, words) if learns(doc_id) for w in own)
    total = sum(count.values())
    for own in words:
        yield (len(own), sum(count[w] > 0 for w in own), total,
               sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own))


def same_scores(got, docs, order):
    want = sorted((str(d), not learns(d), *base[:3], round(base[3], 6), round(score, 6))
                  for (d, _), base, score in zip(docs, plain_base(docs), plain_ppm(docs, order)))
    found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                    round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_score_query_equals_a_plain_trie(spark):
    same_scores(QUERIES["op11_ppm_score"](spark, SF).collect(), documents(), ppm.ORDER)


@pytest.mark.parametrize("order, slice_bytes", [(0, 100), (2, 500), (6, 20_000)])
def test_scores_of_odd_rows_and_small_slices(spark, order, slice_bytes):
    rows = [(i, text, "en", "s") for i, text in enumerate(random_texts(7, 150))]
    rows += [r for r in cases.odd_rows() if r[0] not in (6, 7)]
    got = ppm.score(cases.docs(spark, rows).repartition(3), order, slice_bytes).collect()
    same_scores(got, [r[:2] for r in rows], order)


def test_probabilities_of_a_context_sum_to_one(spark):
    """All symbols after one context, also an unknown one: what escapes give away is what shorter contexts hand out."""
    docs = [(i, t) for i, t in enumerate(random_texts(3, 60))]
    counts = Counter()
    for _, text in docs:
        counts.update(ppm.grams(pa.array([text]), 3)[0].tolist())
    for before in (b"\xff\xff\xff", b"the", b"\x01\x02\x03", b"\x01e ", "é ".encode()):
        keys = [int.from_bytes(before + bytes([s]), "big") for s in range(255)]
        rows = [(k, n) for k, n in counts.items()] + [(k, 0) for k in keys if k not in counts]
        values = ppm.log_probabilities(spark.createDataFrame(rows, "key bigint, n bigint"), 3)
        total = values.where(F.col("key").isin(keys)).agg(F.sum(F.pow(F.lit(10.0), "value")), F.count("*")).first()
        assert total[0] == pytest.approx(1.0) and total[1] == 255


def test_no_training_documents(spark):
    only = [i for i in range(200) if not learns(i)][:3]
    got = ppm.score(cases.docs(spark, [(i, "abc", "en", "s") for i in only])).collect()
    assert [(r["n_known"], r["base_score"]) for r in got] == [(0, 0.0)] * 3
    assert [r["score"] for r in got] == pytest.approx([4 * math.log10(1 / 255)] * 3)


def test_frequent_grams_are_one_entry_per_slice(spark):
    rows = [(i, "the cat sat on the mat " * 50, "en", "s") for i in range(300)]
    dealt = ppm.dealt(cases.docs(spark, rows).coalesce(1), slice_bytes=100_000)
    slices = dealt.select("slice").distinct().count()
    assert 2 <= slices <= 4
    assert dealt.agg(F.sum("entries")).first()[0] < slices * 60


def test_large_buckets_are_split(spark):
    rows = [(i, text, "en", "s") for i, text in enumerate(random_texts(5, 200))]
    docs = cases.docs(spark, rows).repartition(5)
    assert sorted(map(str, ppm.score(docs, 3, 300, group=50).collect())) == sorted(map(str, ppm.score(docs, 3, 300).collect()))


# --- alignment ---------------------------------------------------------------

def byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, docs = byte_of(), []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = whole.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        of_a = [bytes(alphabet[c] for c in whole.id_to_token(i)) for i in a]
        of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in tokens]).tolist() for tokens in (of_a, of_b)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        docs.append((len(a), len(b), groups, links))
    count = Counter(link for d in docs if d for link in d[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d[2])
            yield (d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]),
                   sum(count[x] for x in d[3]), hashlib.sha256(text.encode()).hexdigest())


def test_alignment_query_equals_a_plain_one(spark):
    docs = documents()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_merge_path"](spark, SF).collect()}
    assert got == dict(zip([d for d, _ in docs], plain_alignment([t for _, t in docs])))


@pytest.mark.parametrize("heavy", [4, merge_path.HEAVY])
def test_alignment_of_odd_texts(spark, heavy, monkeypatch):
    monkeypatch.setattr(merge_path, "HEAVY", heavy)  # with 4, nearly all pairs take the way of the rare ones
    rows = [*cases.odd_rows(), *((100 + i, t, "en", "s") for i, t in enumerate(random_texts(3, 1500)))]
    got = merge_path.align_corpus(cases.docs(spark, rows), work=7).collect()
    want = [(str(r[0]), *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]))]
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == sorted(want)


def test_pieces_are_even_and_stitch_to_the_whole():
    rng = random.Random(1)
    for _ in range(2000):
        n, work = rng.randint(0, 30), rng.randint(1, 9)
        a, b = (np.array([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] if n else [], np.int64) for _ in range(2))
        found = merge_path.align(a, b, work)
        at_a, at_b = merge_path.cut(a, b, work)
        assert (np.diff(at_a + at_b) <= work + 1).all() and (at_a[-1], at_b[-1]) == (len(a), len(b))
        ends, common = sorted({*a.tolist(), *b.tolist()}), sorted({*a.tolist()} & {*b.tolist()})
        assert found.ends.tolist() == ends and found.ends[found.closes].tolist() == common
        assert found.a.tolist() == np.searchsorted(a, ends).tolist() and found.b.tolist() == np.searchsorted(b, ends).tolist()
        assert found.group_a.tolist() == np.searchsorted(common, a).tolist()
        assert found.group_b.tolist() == np.searchsorted(common, b).tolist()


def test_overlaps_cover_each_text(spark):
    texts = [t for t in random_texts(4, 300) if t and "▁" not in t]
    got = merge_path.overlaps(cases.docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), work=5).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    encoder = PairEncoder()
    for i, text in enumerate(texts):
        rows, raw = by_doc[i], (" " + text).encode()
        assert b"".join(raw[r["start_byte"]:r["end_byte"]] for r in rows) == raw
        assert [r["token_group"] for r in rows] == np.cumsum([0, *(r["linked"] for r in rows[:-1])]).tolist()
        assert {r["place_a"] for r in rows} == set(range(len(encoder.a.encode_ordinary(" " + text))))
        assert rows[-1]["linked"] and rows[-1]["end_byte"] == len(raw)


def test_alignment_of_no_rows(spark):
    assert merge_path.align_corpus(cases.docs(spark, [])).collect() == []
    assert ppm.score(cases.docs(spark, [])).collect() == []
    assert fill_middle.digest(fill_middle.fill_in_middle(cases.docs(spark, []))).collect() == []


# --- fill in the middle --------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_a_plain_one_and_comes_back(spark):
    texts = [*random_texts(8, 800), "a<S>b", "<P>", "<", "<P", "S>", "x<M>", "<<<", "M>a<"]
    rows = [*cases.odd_rows(), *((100 + i, t, "en", "s") for i, t in enumerate(texts))]
    made = fill_middle.fill_in_middle(cases.docs(spark, rows))
    got = made.withColumn("text", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r[0]), *plain_fim(*r[:2]), r[1] or "") for r in rows)
    assert sorted(((str(r[0]), *tuple(r)[1:]) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
