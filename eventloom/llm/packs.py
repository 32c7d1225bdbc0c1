"""Sorted numbers and words as short binary values, for lists that travel between stages whole."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard

LEVEL = 1


def numbers(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte by byte of their places: high bytes of small numbers are alike."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def read_numbers(raw: bytes, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).reshape(-1).view(kind)


def ascending(values: np.ndarray) -> bytes:
    """Ascending numbers as their steps."""
    return numbers(np.diff(values, prepend=0))


def read_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(read_numbers(raw))


def words(values: Iterable[str]) -> bytes:
    """Words without line ends."""
    return zstandard.ZstdCompressor(level=LEVEL).compress("".join(f"{w}\n" for w in values).encode())


def read_words(raw: bytes) -> pa.Array:
    text = zstandard.ZstdDecompressor().decompress(raw).decode()
    return pa.array(text.split("\n")[:-1], pa.string())
