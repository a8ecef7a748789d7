"""The binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

The code is perfect: every word is within 3 bits of one codeword. A word's keys are the codewords within
4 bits of it: one, or six where the nearest lies 3 bits off. Two words at most 2 bits apart share a key:
take u with nearest codeword c. If u is within 2 bits of c, v is within 4. Else three bits of u differ
from c; if v isn't within 4 of c, v differs from c in those three bits and two more, and the weight-7
codeword (seen from c) that holds the three bits and one of the two is within 4 bits of u and of v.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CHECK_BITS, BITS = 11, 23


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; by syndrome the error patterns of at most 4 bits (zero-filled), and how many."""
    bit = np.array([_remainder(1 << i) for i in range(BITS)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for where in combinations(range(BITS), weight):
            syndrome = 0
            for i in where:
                syndrome ^= int(bit[i])
            # a coset whose leader has at most 2 bits has no pattern of 3, and its patterns of 4 can't occur
            found[syndrome].append(sum(1 << i for i in where))
    count = np.array([len(x) for x in found], np.int64)
    patterns = np.zeros((1 << CHECK_BITS, count.max()), np.int64)
    for s, x in enumerate(found):
        patterns[s, : len(x)] = x
    return bit, patterns, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every 23-bit word; a key is a codeword's 12 message bits."""
    bit, patterns, count = tables()
    syndrome = np.zeros(len(words), np.int64)
    for i in range(BITS):
        syndrome ^= (words >> i & 1) * bit[i]
    n = count[syndrome]
    row = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ patterns[syndrome[row], nth]) >> CHECK_BITS
