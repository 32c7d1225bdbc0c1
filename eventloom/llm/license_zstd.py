"""License notices by conditional compression: how much smaller a block gets when a license text is already known.

A text that holds any of the words that license texts use is read as words, whatever its lines and comment marks. Around
these words it is cut into overlapping windows, for each template as wide as the template and an eighth on both sides. Each
window is compressed alone and with the template as a raw Zstandard dictionary. The bytes saved, against what the
template saves of itself, tell how much of the template the window holds; windows that save too little of it are
dropped, whatever the template's length. The others are ranked by the bytes they save, over all templates. From the
largest saving down, the words of a window and a step on both sides are aligned with the template's, and the place stands if nearly all words of the
template are there in order and no larger saving has taken it. Missing and foreign words are reported, so an altered license
shows how.

Windows begin at multiples of their step in the whole text, which is read in pieces that overlap by more than a window, so the
result does not depend on the pieces. Per row; nothing is shuffled.

Defined cases: null and empty texts hold nothing; a notice that occurs twice is reported twice; where places of several
templates overlap, the one that saves more stands; rows stay one to one; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.frames import pick, slices

LEVEL = 9
#: Share of the bytes that a template saves of itself which a window must save to be looked at. In sf0.1 prose, windows that hold
#: MIN_WORDS_HELD of a template save half of them and more, prose a quarter at most, and other templates' words 0.7 at most.
MIN_SAVING = 0.4
#: Share of a template's words that a place must hold in order.
MIN_WORDS_HELD = 0.85
PIECE_WORDS = 4_096

# Words and phrases of which every license text holds one; phrases may be wrapped and stand behind comment marks.
CUES = (r"(?i)licen[sc]|copyright|reserved|redistribut|warrant|permission|liab|sublicen|public[\W_]+domain"
        r"|as[\W_]+is")

# License texts and notices by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
}

WORDS = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
FOUND = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()),
                   ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        self.words = [w.lower() for w in WORDS.findall(text)]
        self.text = " ".join(self.words)
        self.step = max(1, len(self.words) // 8)
        self.width = len(self.words) + 2 * self.step

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(self.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

    def align(self, near: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """The place in a window: first and last word, missing words, added words."""
        ops = difflib.SequenceMatcher(None, self.words, near, autojunk=False).get_opcodes()
        same = [(j1, j2) for tag, _, _, j1, j2 in ops if tag == "equal"]
        if not same or sum(j2 - j1 for j1, j2 in same) < MIN_WORDS_HELD * len(self.words):
            return None
        first, last = same[0][0], same[-1][1]
        missing = [w for tag, i1, i2, _, _ in ops if tag in ("delete", "replace") for w in self.words[i1:i2]]
        added = [w for tag, _, _, j1, j2 in ops if tag in ("insert", "replace") and first <= j1 < last for w in near[j1:j2]]
        return first, last, missing, added


@dataclass(order=True)
class Window:
    """A window worth a look with a step on both sides, ordered by its rank: the most bytes saved first."""

    rank: tuple[int, int, int]
    share: float = field(compare=False)
    words: list[str] = field(compare=False)
    spans: list[tuple[int, int]] = field(compare=False)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, cues: str = CUES):
        self.templates = [Template(name, text) for name, text in templates.items() if WORDS.search(text)]
        self.cues = re.compile(cues)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.own = [max(1, self.saved(k, t.words)) for k, t in enumerate(self.templates)]

    def saved(self, k: int, words: list[str]) -> int:
        """Bytes by which the words get smaller when template ``k`` is known."""
        raw = " ".join(words).encode()
        return len(self.plain.compress(raw)) - len(self.templates[k].compressor.compress(raw))

    def pieces(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]], bool]]:
        """Places of all words of a text, in overlapping pieces where it is long: the number of the first word, and whether
        the text ends with the piece."""
        overlap = max((t.width + 2 * t.step for t in self.templates), default=0)
        words = (m.span() for m in WORDS.finditer(text))
        piece, base = list(islice(words, PIECE_WORDS + overlap)), 0
        while piece:
            fresh = list(islice(words, PIECE_WORDS))
            yield base, piece, not fresh
            base += len(piece) - overlap
            piece = piece[-overlap:] + fresh if fresh else []

    def starts(self, text: str, base: int, piece: list[tuple[int, int]], ends: bool, template: Template) -> list[int]:
        """Windows of a piece that hold one of the words that license texts use, by their first word in the text."""
        found = set()
        for m in self.cues.finditer(text, piece[0][0], piece[-1][1]):
            at = base + max(0, bisect_left(piece, (m.end(), 0)) - 1)
            first = max(0, -(-(at - template.width + 1) // template.step)) * template.step
            found.update(range(first, at + 1, template.step))
        # with a step on both sides the window must lie in the piece, or else in the one before or after
        first, last = base + (template.step if base else 0), base + len(piece) - (0 if ends else template.width + template.step)
        return sorted(s for s in found if first <= s <= last)

    def windows(self, text: str) -> list[Window]:
        """All windows that save enough, the largest saving first."""
        found: dict[tuple[int, int], Window] = {}
        for base, piece, ends in self.pieces(text):
            words = [text[a:b].lower() for a, b in piece]
            for k, template in enumerate(self.templates):
                for start in self.starts(text, base, piece, ends, template):
                    at = start - base
                    saved = self.saved(k, words[at:at + template.width])
                    if saved >= MIN_SAVING * self.own[k]:
                        near = slice(max(0, at - template.step), at + template.width + template.step)
                        found[k, start] = Window((-saved, start, k), saved / self.own[k], words[near], piece[near])
        return sorted(found.values())

    def scan(self, text: str) -> list[dict]:
        starts: list[int] = []  # of the places that stand, ascending
        out: dict[int, dict] = {}

        def free(begin: int, end: int) -> bool:
            i = bisect_left(starts, end)
            return not i or out[starts[i - 1]]["end"] <= begin

        for window in self.windows(text):
            template = self.templates[window.rank[2]]
            place = template.align(window.words)
            if place:
                first, last, missing, added = place
                begin, end = window.spans[first][0], window.spans[last - 1][1]
                if free(begin, end):
                    insort(starts, begin)
                    out[begin] = {"license": template.name, "start": begin, "end": end, "saving": round(window.share, 4),
                                  "missing": missing, "added": added}
        return [out[s] for s in starts]


def _scan(templates: dict[str, str], cues: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, cues)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text")
                likely = pc.fill_null(pc.match_substring_regex(texts, cues), False)
                found: list[list[dict]] = [[]] * batch.num_rows
                for i in pc.indices_nonzero(likely).to_pylist():
                    found[i] = scanner.scan(texts[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(FOUND))], ["doc_id", "licenses"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, cues: str = CUES) -> DataFrame:
    """``doc_id, licenses`` (name, code points from and to, saving, missing and added words) for every row of ``docs``."""
    schema = ("doc_id bigint, licenses array<struct<license:string,start:bigint,end:bigint,saving:double,"
              "missing:array<string>,added:array<string>>>")
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan(templates, cues), schema)


def digest(found: DataFrame) -> DataFrame:
    """Places as text ``license:start:end:missing:added`` (the last two as numbers of words), comma-joined."""
    def written(x):
        return F.concat_ws(":", x["license"], x["start"], x["end"], F.size(x["missing"]), F.size(x["added"]))

    exact = F.filter("licenses", lambda x: (F.size(x["missing"]) == 0) & (F.size(x["added"]) == 0))
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.size(exact).cast("bigint").alias("n_exact"),
        F.array_join(F.transform("licenses", written), ",").alias("licenses"))
