"""The perfect binary Golay code of 23 bits: nearby codewords of a word.

Each 23-bit word lies within 3 bits of exactly one codeword.  A word at 3 bits from it also has five
codewords at 4 bits.  Taking these as the word's keys (one key, or six), any two words that differ in
at most two bits have a key in common; ``tests/llm`` proves it by enumeration.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from parcelflow.llm.worker import once

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK_BITS = 23, 11
KEYS = 6


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by byte of the word, and for each remainder the error patterns (-1 where there are fewer)."""
    by_byte = np.array([[_remainder(v << 8 * k & (1 << BITS) - 1) for v in range(256)] for k in range(3)], dtype=np.int64)
    patterns = np.full((1 << CHECK_BITS, KEYS), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    single = [_remainder(1 << i) for i in range(BITS)]
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            patterns[rest, filled[rest]] = sum(1 << b for b in bits)
            filled[rest] += 1
    return by_byte, patterns


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """For each word, the 12-bit indices of its nearby codewords: one row of six, -1 where there are fewer."""
    by_byte, patterns = once(("golay",), _tables)
    rest = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    near = patterns[rest]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> CHECK_BITS)
