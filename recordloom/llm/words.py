"""Words, word hashes and word shingles shared by the text operators."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_CACHE: dict[str, int] = {}
_CACHE_WORDS = 500_000  # the cache is emptied beyond this, so a worker's memory stays bounded


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after lower-casing."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, in text order; none where there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _MIX + hashes[i : i + n]
    return mix(h)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list array of numpy parts."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of an Arrow list column of integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def flat(lists: list[list]) -> list:
    return list(chain.from_iterable(lists))
