"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 200_000


class Words(dict):
    """Hash of a word, remembered; forgets all beyond a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: Words, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only, which is what bytes.lower and
    bytes.split do.  Fewer words than a shingle make one shingle; no word makes none."""
    found = text.encode().lower().split() if text else []
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    width = min(size, n)
    count = n - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = total * _STEP + h[k : k + count]
    return np.unique(mixed(total))
