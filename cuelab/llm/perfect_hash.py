"""Minimal perfect hashing of digests: n distinct keys to the slots 0 to n-1.

Levels of tables twice as long as the keys that are left: a key alone in its cell gets the next slot, the
others go to the next level. Every slot keeps its key, so a key that is not in the table is told apart.
"""

from __future__ import annotations

import numpy as np

MOST_LEVELS = 64


def digests(values: list[bytes]) -> np.ndarray:
    """Digests of 16 bytes as rows of two unsigned numbers."""
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, 2)


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """``keys``: distinct rows of two unsigned numbers. ``slots`` has the slot of each."""
        self.keys = np.empty_like(keys)
        self.slots = np.empty(len(keys), np.int64)
        self.levels: list[np.ndarray] = []
        left, filled = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("a digest is repeated")
            size = 2 * len(left) + 1
            cell = self._cells(keys[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            table, here = np.full(size, -1, np.int64), left[alone]
            table[cell[alone]] = self.slots[here] = filled + np.arange(len(here))
            self.keys[self.slots[here]] = keys[here]
            self.levels.append(table)
            left, filled = left[~alone], filled + len(here)

    @staticmethod
    def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, table in enumerate(self.levels):
            slot = table[self._cells(keys[left], level, len(table))]
            found[left] = slot
            left = left[slot < 0]
        hit = np.flatnonzero(found >= 0)
        found[hit[(self.keys[found[hit]] != keys[hit]).any(axis=1)]] = -1
        return found
