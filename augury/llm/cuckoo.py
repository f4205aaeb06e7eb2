"""Cuckoo filter: a compact set of 128-bit keys that allows deletions."""

from __future__ import annotations

import numpy as np

from augury.llm.shingles import mixed

SLOTS = 4
KICKS = 500


class Full(Exception):
    pass


class Cuckoo:
    """16-bit fingerprints in buckets of four; no false negatives, false positives about 1 in 8,000."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def sized(cls, keys: int) -> "Cuckoo":
        """Room for so many keys at half load."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS * 2))))
        return cls(np.zeros((buckets, SLOTS), "<u2"))

    @classmethod
    def loads(cls, data: bytes) -> "Cuckoo":
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray):
        mask = np.uint64(len(self.cells) - 1)
        mark = (np.asarray(lo).view(np.uint64) >> np.uint64(48)) | np.uint64(1)
        first = mixed(np.asarray(hi).view(np.uint64)) & mask
        return mark, first, first ^ (mixed(mark) & mask)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hi, lo)
        mark = mark.astype(np.uint16)[:, None]
        return (self.cells[one] == mark).any(axis=1) | (self.cells[two] == mark).any(axis=1)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        mask = len(self.cells) - 1
        for mark, one, two in zip(*(x.tolist() for x in self._places(hi, lo))):
            at = one
            for kick in range(KICKS):
                for place in (one, two) if kick == 0 else (at,):
                    free = np.flatnonzero(self.cells[place] == 0)
                    if len(free):
                        self.cells[place, free[0]] = mark
                        break
                else:
                    slot = kick % SLOTS
                    mark, self.cells[at, slot] = int(self.cells[at, slot]), mark
                    at ^= int(mixed(np.array([mark], np.uint64))[0]) & mask
                    continue
                break
            else:
                raise Full

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Keys must have been added before."""
        for mark, one, two in zip(*(x.tolist() for x in self._places(hi, lo))):
            for place in (one, two):
                held = np.flatnonzero(self.cells[place] == mark)
                if len(held):
                    self.cells[place, held[0]] = 0
                    break
