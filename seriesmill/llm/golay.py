"""The binary Golay code [23, 12, 7] and the fuzzy keys that it gives.

Every 23-bit word lies within 3 bits of exactly one codeword. A word at distance 3 from its codeword has exactly five
more codewords at distance 4. With all codewords within distance 4 as keys (one key or six), two words that differ in at
most two bits share a key: if their nearest codewords differ, the triangle inequality puts one of them in both key sets.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011
LENGTH, MESSAGE, CHECK, KEYS = 23, 12, 11, 6


def _remainder(v: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK)
    return v


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; per syndrome its error patterns of weight 4 at most, and their number."""
    low = np.array([_remainder(v) for v in range(1 << 12)], np.uint32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.uint32)
    errors = np.zeros((1 << CHECK, KEYS), np.uint32)
    count = np.zeros(1 << CHECK, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = low[e & 0xFFF] ^ high[e >> 12]
            errors[s, count[s]] = e
            count[s] += 1
    return low, high, errors, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: codeword indices (n, 6), nearest first, and which of them count."""
    low, high, errors, count = tables()
    words = words.astype(np.uint32)
    s = low[words & np.uint32(0xFFF)] ^ high[words >> np.uint32(12)]
    index = (words[:, None] ^ errors[s]) >> np.uint32(CHECK)
    return index, np.arange(KEYS) < count[s][:, None]
