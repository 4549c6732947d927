"""Perfect binary codes: every word is within `radius` bits of exactly one codeword, which makes the codewords anchors.

The Golay code of length 23 and radius 3 has 4,096 codewords, the Hamming code of length 15 and radius 1 has 2,048.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np


class Code:
    """A cyclic perfect code, given by its length, generator polynomial and covering radius."""

    def __init__(self, length: int, generator: int, radius: int):
        self.length, self.generator, self.radius = length, generator, radius
        self.checks = generator.bit_length() - 1

    @cache
    def _syndrome_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Syndromes (remainders by the generator) of the low 12 and the other bits of a word."""

        def remainder(x: int) -> int:
            for k in range(self.length - 1, self.checks - 1, -1):
                if x >> k & 1:
                    x ^= self.generator << (k - self.checks)
            return x

        unit = [remainder(1 << k) for k in range(self.length)]
        tables = []
        for lo, n in ((0, 12), (12, self.length - 12)):
            t = np.zeros(1 << n, np.int64)
            for k in range(n):
                t[1 << k : 2 << k] = t[: 1 << k] ^ unit[lo + k]
            tables.append(t)
        return tables[0], tables[1]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        low, high = self._syndrome_tables()
        return low[words & 0xFFF] ^ high[words >> 12]

    @cache
    def patterns(self, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error patterns of up to radius + reach bits, sorted by syndrome: (patterns, excess over the radius, start of each syndrome)."""
        errors = [sum(1 << k for k in c) for w in range(self.radius + reach + 1) for c in combinations(range(self.length), w)]
        e = np.array(errors, np.int64)
        excess = np.maximum(np.array([x.bit_count() for x in errors]) - self.radius, 0)
        s = self.syndrome(e)
        order = np.lexsort((excess, s))
        return e[order], excess[order], np.searchsorted(s[order], np.arange((1 << self.checks) + 1))

    def anchors(self, words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, codeword, excess): all codewords within radius + reach of each word; those of excess 0 are the nearest ones."""
        e, excess, start = self.patterns(reach)
        s = self.syndrome(words)
        n = start[s + 1] - start[s]
        row = np.repeat(np.arange(len(words)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
        return row, words[row] ^ e[at], excess[at]


GOLAY = Code(23, 0b101011100011, 3)  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
HAMMING = Code(15, 0b10011, 1)  # x^4 + x + 1
