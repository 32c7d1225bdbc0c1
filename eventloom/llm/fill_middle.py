"""Fill-in-the-middle texts by one chain of ``pyarrow.compute`` calls per batch.

A document's units (runs of ASCII letters, any other single character) are marked off with a byte that UTF-8 never
uses and split into a list array. The lists are flattened with their parent indices; a unit's ordinal is its place
less its parent's offset, and the parent's two cuts turn it into a role (prefix, middle, suffix). Each role's units are
filtered, rebuilt as lists by their counts and joined again, and the pieces are put together in the order of the
document's form. Cuts and forms come from a hash of ``seed:doc_id``, so that reruns agree.

The operator is a map: nothing is shuffled, and a Python worker holds one slice of a batch (``SLICE`` bytes of text, or one
longer text) at a time. ``restore`` takes a text back from its output and form with native functions alone.

Defined cases: a null text counts as empty and is plain with no units; a null id hashes as empty text; repeated rows
have the same result each; extra columns are ignored; an empty table gives an empty result. A text that holds one of
the markers itself stays plain, so that every output can be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import pick, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: Units as patterns over bytes: a run of letters, another ASCII character, or a longer UTF-8 sequence.
UNIT = r"([A-Za-z]+|[\x00-\x7F]|[\xC0-\xFE][\x80-\xBF]*)"
#: Closes each unit; no UTF-8 text holds this byte.
MARK = b"\xff"
SLICE = 4 << 20

RESULT = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of all texts, each unit's text, and where each text's units begin (one place more than texts)."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=b"\\1" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK)  # a last, empty part follows the last mark
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    last = np.append(parents[1:] != parents[:-1], True) if len(parents) else np.zeros(0, bool)
    counts = pc.list_value_length(lists).to_numpy() - 1
    places = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=places[1:])
    return values.filter(pa.array(~last)), parents[~last], places


def _rebuilt(units: pa.Array, parents: np.ndarray, roles: np.ndarray, role: int, n: int) -> pa.Array:
    """Per text the joined units of one role."""
    own = roles == role
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(parents[own], minlength=n), out=ends[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), units.filter(pa.array(own))), b"").cast(pa.string())


def _transform(batch: pa.RecordBatch, plain: int, suffix_first: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    units, parents, places = _units(texts)
    n = np.diff(places)
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    ordinals = np.arange(len(parents)) - places[parents]
    roles = (ordinals >= low[parents]).astype(np.int8) + (ordinals >= high[parents])
    prefix, middle, suffix = (_rebuilt(units, parents, roles, role, len(texts)) for role in range(3))

    taken = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE))).to_numpy(zero_copy_only=False)
    stays = pa.array((n == 0) | taken | (h3 % 100 >= 100 - plain))
    first = pa.array(h4 % 100 < suffix_first)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    form = pc.if_else(stays, "plain", pc.if_else(first, "spm", "psm"))
    output = pc.if_else(stays, texts, pc.if_else(first, spm, psm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(stays, none, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n), form, *chars, output], [x.split()[0] for x in RESULT.split(", ")])


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: its number of units, the form, the lengths of two pieces and the rearranged text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                yield _transform(batch, plain, suffix_first)

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = (F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4))
    return rows.select("doc_id", "text", *hashes).mapInArrow(run, RESULT)


def restore(output: Column, form: Column) -> Column:
    """The document's text from what ``fill_in_middle`` made of it.

    No marker can begin inside a piece and end inside a marker, so the first place of each is the right one.
    """
    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.char_length(F.substring_index(text, mark, 1)) + F.lit(len(mark) + 1))

    def until(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    middle = after(output, MIDDLE)
    psm = F.concat(until(after(output, PREFIX), SUFFIX), middle, until(after(output, SUFFIX), MIDDLE))
    spm = F.concat(until(after(output, PREFIX), MIDDLE), middle, until(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with hashes in place of texts, one of them of the text taken back."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
