"""The perfect binary Golay code (23 bits, 4,096 codewords, distance 7) as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one codeword. A word that differs from it in at most
one bit lies within 4 bits of the same codeword. So the codewords within 4 bits of a word, one or
six of them, contain the nearest codeword of every word one bit away.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np

#: The generator polynomial of the code: fixed value.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """``nearest`` and ``within_four`` of arrays of 23-bit words: numbers of codewords, below 4,096."""

    def __init__(self) -> None:
        unit = [_remainder(1 << b) for b in range(23)]
        low, high = [0], [0]  # remainders of the 11 low and the 12 high bits
        for b in range(11):
            low += [x ^ unit[b] for x in low]
        for b in range(11, 23):
            high += [x ^ unit[b] for x in high]
        self.low, self.high = np.array(low, np.int32), np.array(high, np.int32)
        errors = np.full((2048, 6), -1, np.int32)
        for n in range(4):
            for places in combinations(range(23), n):
                errors[reduce(xor, (unit[b] for b in places), 0), 0] = sum(1 << b for b in places)
        filled = np.ones(2048, np.int64)
        for places in combinations(range(23), 4):
            k = reduce(xor, (unit[b] for b in places), 0)
            if int(errors[k, 0]).bit_count() == 3:  # else the codeword would be nearer than 4 bits to another
                errors[k, filled[k]] = sum(1 << b for b in places)
                filled[k] += 1
        self.errors = errors

    def _syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0x7FF] ^ self.high[words >> 11]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self._syndrome(words), 0]) >> 11

    def within_four(self, words: np.ndarray) -> np.ndarray:
        """Six columns, -1 where there are no more."""
        errors = self.errors[self._syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
