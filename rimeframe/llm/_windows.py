"""Hashes of all windows of a run of documents at once, in numpy.

Documents lie one behind the other; a unit (word or byte) has a 64-bit value; a window's hash is the polynomial of its
values, taken from prefix sums modulo 2**64, and mixed.
"""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int, side: int) -> np.ndarray:
    got = _powers.get((base, side))
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        row = np.full(size, base if side > 0 else pow(base, -1, 1 << 64), np.uint64)
        row[0] = 1
        got = _powers[base, side] = np.cumprod(row, dtype=np.uint64)
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of each window of ``length`` units, by its first unit; windows over the end of a document are included."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64)
    base = _BASES[which]
    if which:
        values = mixed(values + np.uint64(which))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _power(base, n, 1), dtype=np.uint64, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * _power(base, n - length + 1, -1))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def distinct_pairs(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indices of one row for each distinct (doc, keys)."""
    if not len(doc):
        return np.empty(0, np.int64)
    order = np.lexsort((*keys[::-1], doc))
    new = np.ones(len(order), bool)
    new[1:] = doc[order][1:] != doc[order][:-1]
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]
