"""Personal data in text: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (``email``, ``ip``, ``card``, ``phone``) are fixed: every match of the pattern that passes its
test is a span, whatever its score. Three further kinds are added only where the score reaches
``ADD_AT``: ``iban`` (mod-97), ``card_in_run`` (a Luhn number with a card issuer's lead, written next to other digits,
which the base pattern swallows into one failing run) and ``national_id`` (a bare pattern, so words nearby decide).

Offsets count code points, ends are exclusive. Patterns run over the whole text in time linear in its length
(possessive or anchored forms, e-mail by its ``@``). Per row, so nothing is shuffled and nothing is kept.

Defined cases: null and empty texts have no spans; rows stay one to one, repeated ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import pick, slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "card_in_run", "national_id")
ADD_AT = 0.75
CONTEXT_CHARS = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
MAY_HOLD = "[0-9@]"

# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# Leading digits of card issuers with the lengths of their numbers.
ISSUERS = (("4", (13, 16, 19)), ("5", (16,)), ("34", (15,)), ("37", (15,)), ("6011", (16,)), ("35", (16,)), ("2", (16,)))
# Words whose nearness raises (or, for all kinds, lowers) the score.
NEAR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("address", "host", "server", "client", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appel"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "national_id": ("ssn", "social security", "tax id", "national id"),
}
AGAINST = ("version", "isbn", "part number", "serial", "checksum", "example only")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                  ("base", pa.bool_())])


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part reaches back from its ``@`` to the last match or foreign character."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    around = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
    score = 0.4 + 0.4 * confirmed
    score += 0.4 * any(word in around for word in NEAR[kind])
    score -= 0.2 * any(word in around for word in AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def base_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for start, end in emails(text):
        yield "email", start, end, False
    for m in IP.finditer(text):
        # a part longer than any number up to 255, its leading zeros aside, fails without being converted
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            yield "ip", m.start(), m.end(), True
    for m in DIGIT_RUN.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end(), False


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The pattern reaches over what follows a number, so the search goes on behind the country's length or, where none is
    confirmed, behind the candidate's first character."""
    m = IBAN.search(text)
    while m:
        after = m.start() + 1
        places = [i for i in range(m.start(), m.end()) if text[i] != " "]
        want = IBAN_LENGTHS.get(m.group(1), len(places) + 1)
        if len(places) >= want and mod97("".join(text[i] for i in places[:want])):
            after = places[want - 1] + 1
            yield m.start(), after
        m = IBAN.search(text, after)


def added_spans(text: str, taken: set[tuple[int, int]]) -> Iterator[tuple[str, int, int, bool]]:
    for start, end in ibans(text):
        yield "iban", start, end, True
    for m in DIGIT_RUN.finditer(text):
        if m.span() in taken or m.end() - m.start() < 14:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer(r"[0-9]+", m.group())]
        for i in range(len(groups)):
            number = ""
            for j in range(i, min(i + 5, len(groups))):
                number += text[groups[j][0]:groups[j][1]]
                lengths = next((ls for lead, ls in ISSUERS if number.startswith(lead)), ())
                if len(groups) > 1 and len(number) in lengths and luhn(number):
                    yield "card_in_run", groups[i][0], groups[j][1], True
    for m in NATIONAL_ID.finditer(text):
        yield "national_id", m.start(), m.end(), False


class Taken:
    """Places that spans take, joined where they overlap; asked and added to by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Take a place, if nothing overlaps it."""
        i = bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def spans_of(text: str) -> list[dict]:
    """All spans of a text, by kind as listed above, then by start."""
    found = [{"kind": kind, "start": start, "end": end, "score": _score(kind, text, start, end, ok), "base": True}
             for kind, start, end, ok in base_spans(text)]
    taken = Taken([(x["start"], x["end"]) for x in found])
    cards = {(x["start"], x["end"]) for x in found if x["kind"] == "card"}
    for kind, start, end, ok in added_spans(text, cards):
        score = _score("card" if kind == "card_in_run" else kind, text, start, end, ok)
        if score >= ADD_AT and taken.add(start, end):
            found.append({"kind": kind, "start": start, "end": end, "score": score, "base": False})
    order = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(found, key=lambda x: (order[x["kind"]], x["start"]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = batch.column("text")
            likely = pc.fill_null(pc.match_substring_regex(texts, MAY_HOLD), False)
            found: list[list[dict]] = [[]] * batch.num_rows
            for i in pc.indices_nonzero(likely).to_pylist():
                found[i] = spans_of(texts[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, start, end, score from 0 to 1, base) for every row of ``docs`` (``doc_id, text``)."""
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
    named = pick(docs, "doc_id", "text")
    return named.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_find, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))
