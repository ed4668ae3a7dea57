"""The (23, 12) binary Golay code: every 23-bit word is within three bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the values of each byte of a word, and the error pattern of each syndrome."""
    unit = []
    for i in range(LENGTH):
        r = 1 << i
        for shift in range(i - 11, -1, -1):
            if r >> (shift + 11) & 1:
                r ^= GENERATOR << shift
        unit.append(r)
    by_byte = np.zeros((3, 256), np.uint16)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < LENGTH:
                    by_byte[byte, value] ^= unit[8 * byte + bit]
    errors = np.zeros(2048, np.uint32)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return by_byte, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each word."""
    by_byte, errors = tables()
    w = words.astype(np.uint32)
    syndrome = by_byte[0, w & 255] ^ by_byte[1, w >> 8 & 255] ^ by_byte[2, w >> 16 & 255]
    return (w ^ errors[syndrome]) >> 11


def around(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the different codewords nearest to each word or to a word one of its `bits` off."""
    w = words.astype(np.uint32)[:, None]
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)[None, :]
    index = np.sort(nearest(w ^ flips), axis=1)
    fresh = np.ones(index.shape, bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    row, col = np.nonzero(fresh)
    return row, index[row, col]
