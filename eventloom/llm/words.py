"""Words of many texts as numbers: per slice each distinct word is handled once, whatever its frequency."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Recent:
    """Remembers computed values in bounded memory: of two generations the older one goes when the younger is full."""

    def __init__(self, limit: int = 150_000, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: Sequence[str], make: Callable) -> list:
        young, old, out = self.young, self.old, []
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    value = make(key)
                if len(key) <= self.longest:
                    young[key] = value
            out.append(value)
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, codes, words)``: text ``i`` consists of the words ``words[codes[places[i]:places[i + 1]]]``.

    Words are the runs between ASCII white space; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    parts = lists.flatten().dictionary_encode()
    codes = parts.indices.to_numpy().astype(np.int64)
    words = parts.dictionary.to_numpy(zero_copy_only=False)
    empty = np.flatnonzero(words == "")  # before leading and after trailing white space
    if len(empty):
        full = codes != empty[0]
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(full, out=before[1:])
        ends, codes = before[ends], codes[full]
    return ends, codes, words
