"""Word shingles as 64-bit hashes, for use inside Spark tasks.

Words are the runs of bytes that are not ASCII white space, after A-Z are
lower-cased: exactly what ``bytes.lower().split()`` gives, so a text is cut
without any Python loop over its characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


class WordHashes(dict):
    """Word -> 64-bit hash, filled on first use; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64) of a text.

    A text of fewer than ``width`` words is one shingle, the whole sequence; a
    text without words, or a null, is the empty set.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    acc = h[: len(h) - w + 1].copy()
    for i in range(1, w):
        acc *= _MUL
        acc += h[i : len(h) - w + 1 + i]
    return np.unique(mix64(acc + np.uint64(w)))
