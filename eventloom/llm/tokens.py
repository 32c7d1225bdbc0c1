"""Token ids of many texts with a public byte-level BPE vocabulary.

A text may be cut before any space that follows a character other than white space without changing its ids:
the vocabulary's splitting pattern takes spaces only in front of a word or within white space. So texts are
cut there, each distinct piece is encoded once and remembered, and ids of whole texts are gathered by numpy.
Texts in which a space follows white space, or which hold a special token's string, are encoded whole.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from eventloom.llm.words import Recent

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space of the splitting pattern, before a space; or what starts a special token.
WHOLE = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |<\|")


@dataclass
class Encoder:
    """Ids as ``tokenizers`` gives them for ``tokenizer``; ``ranks`` is the same vocabulary for a faster library."""

    tokenizer: str = TOKENIZER
    ranks: str = RANKS
    pieces: Recent = field(default_factory=Recent)

    def __post_init__(self):
        self.whole = Tokenizer.from_file(self.tokenizer)
        with open(self.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})

    def _bytes(self, piece: str) -> bytes:
        return np.array(self.part.encode_ordinary(piece), dtype="<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one place more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(plain, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        parts = lists.flatten().dictionary_encode()
        codes = parts.indices.to_numpy().astype(np.int64)
        kept = [" " + piece for piece in parts.dictionary.to_numpy(zero_copy_only=False)]
        found = self.pieces.get(kept, self._bytes)
        first = ends[:-1]  # the first part of a text has no space before it
        leading = parts.dictionary.to_numpy(zero_copy_only=False)[codes[first]]
        for i, piece in enumerate(leading):
            if odd[i]:
                whole = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
                found.append(np.array(whole, dtype="<u4").tobytes())
            else:
                found.append(self._bytes(piece))
        codes[first] = np.arange(len(first)) + len(kept)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), dtype="<u4")
        ids, places = gather(table, np.cumsum(lengths) - lengths, lengths, codes)
        return ids, places[ends]


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` that ``codes`` name, one after another, and the places between them."""
    own = lengths[codes]
    places = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(own, out=places[1:])
    index = np.arange(places[-1])
    index += np.repeat(starts[codes] - places[:-1], own)
    return table[index], places
