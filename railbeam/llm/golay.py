"""Nearest codewords of the binary Golay code of length 23, for many words at once.

The code is perfect: every 23-bit word lies within three bits of exactly one of 4,096 codewords. A word and all
words one bit away from it decode to at most six codewords, and two words at most two bits apart have one of
them in common, because some word lies within one bit of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for shift in range(LENGTH - CHECK_BITS - 1, -1, -1):
        if word >> (shift + CHECK_BITS) & 1:
            word ^= GENERATOR << shift
    return word


#: Remainder of the upper twelve bits; the lower eleven are their own.
_UPPER = np.array([_remainder(high << CHECK_BITS) for high in range(1 << (LENGTH - CHECK_BITS))], np.uint32)


def _corrections() -> np.ndarray:
    table = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << bit for bit in bits)
            table[_remainder(error)] = error
    return table


_ERROR = _corrections()


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4,095) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    low = words & np.uint32((1 << CHECK_BITS) - 1)
    error = _ERROR[_UPPER[words >> np.uint32(CHECK_BITS)] ^ low]
    return (words ^ error) >> np.uint32(CHECK_BITS)


def indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every index near each word: (position of the word, index), each index once per word.

    Only the lowest ``bits`` bits are in use, so only they are flipped. Words at most two bits apart share an index.
    """
    flips = np.array([0, *(1 << bit for bit in range(bits))], np.uint32)
    found = np.sort(nearest(words.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns]
