"""The perfect binary Golay code of length 23, as a way to give near 23-bit words a common key.

Every 23-bit word lies within 3 bits of exactly one codeword. The keys of a word are that codeword and, for a word that lies exactly
3 bits off, the five codewords 4 bits off. Two words that differ in at most two bits have a key in common: seen from the first
word's codeword, words of one, two or three set bits and their neighbours either stay within 3 bits of it, or share one of the words of
weight 7 that contain four given places, of which there is exactly one for any four.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DIMENSION = 23, 12
CHECKS = LENGTH - DIMENSION
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a factor of x^23 - 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message; the error of each remainder; and by remainder what to add to the nearest codeword for each key (-1: none)."""
    checks = np.array([_remainder(m << CHECKS) for m in range(1 << DIMENSION)], np.int64)
    words = np.arange(1 << DIMENSION) << CHECKS | checks
    heavy = words[np.bitwise_count(words) == 7]
    error = np.zeros(1 << CHECKS, np.int64)
    beyond = np.full((1 << CHECKS, 6), -1, np.int64)
    beyond[:, 0] = 0
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            s = int(checks[e >> CHECKS]) ^ (e & (1 << CHECKS) - 1)
            error[s] = e
            if weight == 3:
                beyond[s, 1:] = heavy[heavy & e == e]
    return checks, error, beyond


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six 12-bit keys, and which of them there are (one or six)."""
    checks, error, beyond = tables()
    rest = checks[words >> CHECKS] ^ (words & (1 << CHECKS) - 1)
    add = beyond[rest]
    return (words ^ error[rest])[:, None] >> CHECKS ^ add >> CHECKS, add >= 0
