"""Words and word shingles of bytes. A word is a run of [^\\x20\\x09-\\x0D], as bytes.split() cuts it."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from almanac.llm.packed import mix

ODD = np.uint64(0x100000001B3C0DE5)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; one of all of them where there are fewer; none of none."""
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * ODD + h[j : n - width + 1 + j]
    return mix(out)


def shingles(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text whose A-Z count as a-z."""
    return np.unique(runs(hashes(data.lower().split()), k))
