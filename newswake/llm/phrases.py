"""Prefix-free phrases of byte strings, and the hashes of their substrings.

A rolling hash over WINDOW bytes picks triggers: among the windows that lie in SPAN bytes from a
position, the one with the least hash. Positions with the same trigger are a phrase's head; the
phrase is the head and the SPAN - 1 bytes after it. Phrases overlap, none is a prefix of what
follows another trigger, and a string of SPAN bytes lies in one phrase only, at the place its own
bytes say: equal strings have equal triggers wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPAN = 50
WINDOW = 24
MULTIPLIER = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """A random-looking odd number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    def of(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return of(MULTIPLIER), of(pow(MULTIPLIER, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


@dataclass
class Hashed:
    """Hash of any stretch of a byte string from sums of letters times powers."""
    data: np.ndarray

    def __post_init__(self):
        n = len(self.data)
        up, self.down = powers((n >> 19) + 1 << 19)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters()[self.data] * up[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """Of the strings of `width` bytes from each position on."""
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[:len(h)]
        return mixed(h)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))


def phrases(h: Hashed, starts: np.ndarray, ends: np.ndarray):
    """(head start, head end, trigger hash, document) for documents at starts..ends of the string:
    the head's positions are those from which SPAN bytes lie in the document."""
    empty = np.zeros(0, np.int64)
    n = len(h.data)
    if n < SPAN:
        return empty, empty, np.zeros(0, np.uint64), empty
    window = h.windows(WINDOW)
    at = (window >> U(32) << U(32)) | np.arange(len(window), dtype=np.uint64)
    width, low = 1, at
    while 2 * width <= SPAN - WINDOW + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - WINDOW + 1 - width
    low = np.minimum(low[:len(low) - rest], low[rest:])  # over all windows of SPAN bytes
    trigger = (low & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    whole = ends - starts >= SPAN
    inside[starts[whole]] += 1
    inside[ends[whole] - SPAN + 1] -= 1
    valid = np.cumsum(inside[:len(trigger)]).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty, empty, np.zeros(0, np.uint64), empty
    # a head ends before the next one or where the document's positions end
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
    last = np.flatnonzero(stop) + 1
    doc = np.searchsorted(starts, first, "right") - 1
    # least hashes are small numbers; mixed once more they spread evenly over buckets
    return first, last, mixed(window[trigger[first]] ^ U(0x5851F42D4C957F2D)), doc
