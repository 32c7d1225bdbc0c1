"""Ids of two vocabularies for the same bytes, of many texts at once.

Vocabulary A is byte-level BPE, B is BPE over pieces that stand for a space by U+2581 and fall back to bytes. Both see a space in
front of the text (B adds its own). Neither has a token that goes on over a space which follows something other than
white space: A's splitting pattern takes a space only in front of a word or among white space, and no piece of
B has its space mark behind another character. So texts are cut there, each distinct part is encoded once and remembered,
and the ids of whole texts are gathered by numpy. Merges of BPE in one part never depend on another part.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken

from eventloom.llm.tokens import RANKS, gather
from eventloom.llm.words import Recent

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: A space behind white space, which is no cut; such texts are cut one by one.
BEHIND_SPACE = (r"(^|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) ")
CUT = re.compile(r"(?<=\S) ")


@dataclass
class Tokens:
    """Tokens of several texts in a row: ids, bytes of each, and where each text's tokens begin."""

    ids: np.ndarray
    sizes: np.ndarray
    places: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """Byte offset behind each token; texts follow one another without a gap."""
        return np.cumsum(self.sizes)


@dataclass
class PairEncoder:
    ranks: str = RANKS
    pieces: str = PIECES
    seen: Recent = field(default_factory=Recent)

    def __post_init__(self):
        with open(self.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {rank: token for token, rank in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.pieces)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _part(self, part: str) -> tuple[bytes, bytes, bool]:
        """Ids of both vocabularies of one part, which starts with a space, and whether both give its bytes back."""
        raw = part.encode()
        a = self.a.encode_ordinary(part)
        # the library puts no space in front of nothing
        b = self.b.encode(part[1:], num_threads=1) if len(part) > 1 else [self.b.piece_to_id(SPACE)]
        same = b"".join(map(self.a_bytes.get, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes(), same

    def encode(self, texts: pa.Array) -> tuple[Tokens, Tokens]:
        """Tokens of both vocabularies. A text has none where it is null or empty or one of them loses a byte of it."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, BEHIND_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        parts = lists.flatten().dictionary_encode()
        codes = parts.indices.to_numpy().astype(np.int64)
        keys = [" " + x for x in parts.dictionary.to_numpy(zero_copy_only=False)]
        if odd.any():
            own = {i: CUT.split(" " + texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
            known = {key: i for i, key in enumerate(keys)}
            runs, starts = [], np.cumsum(counts) - counts
            before = 0
            for i, cut in own.items():
                runs += [codes[before:starts[i]], np.array(
                    [known.setdefault(key, len(known)) for key in (cut[0], *(" " + x for x in cut[1:]))], np.int64)]
                before, counts[i] = starts[i] + 1, len(cut)
            codes, keys = np.concatenate([*runs, codes[before:]]), list(known)
        found = self.seen.get(keys, self._part)
        text_of = np.repeat(np.arange(len(counts)), counts)
        lost = np.bincount(text_of, weights=~np.array([x[2] for x in found], bool)[codes], minlength=len(counts)) > 0
        none = lost | (pc.binary_length(texts).to_numpy() == 0)
        full = ~none[text_of]
        codes, counts = codes[full], np.where(none, 0, counts)
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        return self._gathered([x[0] for x in found], codes, ends, self.a_sizes), \
            self._gathered([x[1] for x in found], codes, ends, self.b_sizes)

    @staticmethod
    def _gathered(found: list[bytes], codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Tokens:
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<i4")
        ids, places = gather(table, np.cumsum(lengths) - lengths, lengths, codes)
        return Tokens(ids, sizes[ids], places[ends])
