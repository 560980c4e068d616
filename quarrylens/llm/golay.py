"""The perfect binary Golay code of 23 bits: every word lies within three bits of one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK = 23, 11


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and the error of each syndrome."""
    unit = [_remainder(1 << i) for i in range(24)] if BITS > 23 else [_remainder(1 << i) for i in range(BITS)] + [0]
    syndromes = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    syndromes[byte, value] ^= unit[8 * byte + bit]
    errors = np.zeros(1 << CHECK, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(BITS), weight):
            s = 0
            for p in places:
                s ^= unit[p]
            errors[s] = sum(1 << p for p in places)
    return syndromes, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    syndromes, errors = _tables()
    s = syndromes[0][words & 255] ^ syndromes[1][words >> 8 & 255] ^ syndromes[2][words >> 16 & 255]
    return (words ^ errors[s]) >> CHECK


def near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords nearest to each word or to a word one of its ``bits`` low bits away."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows = np.nonzero(new)[0]
    return rows, found[new]
