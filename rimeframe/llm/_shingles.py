"""Hashes of word shingles, a run of text at a time in numpy.

A word's hash is a polynomial over its bytes modulo 2^64 with random byte values, taken from running sums over the run, and
mixed; a shingle's hash is a sum of its words' hashes times odd factors, mixed.  They tell shingles apart; where a contract
names a hash, it is not this one.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

SEED = 42
#: Bytes hashed at once, and the longest word that is hashed by running sums; longer ones are hashed with XXH64.
PIECE, LONG = 1 << 17, 1 << 10

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) for b in _LOWER], np.uint64)
_BASE = xxhash.xxh64_intdigest(b"base", SEED) | 1
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)  # fixed values: the multipliers of MurmurHash3's 64-bit finalizer


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + LONG, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    shift = np.uint64(33)
    for factor in _MIX:
        h = (h ^ (h >> shift)) * np.uint64(factor)
    return h ^ (h >> shift)


def _of_piece(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data``, which is at most PIECE + LONG long."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[values], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_VALUE[values] * _POWER[: len(values)], out=sums[1:])
    out = _mixed((sums[ends] - sums[starts]) * _INVERSE[starts])
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = _of_long(data[starts[i] : ends[i]])
    return out


def _of_long(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.translate(_LOWER), SEED)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of the text, A-Z lower-cased.  Pieces end at a gap, so that no word is cut."""
    data = text.encode() if text else b""
    out, at = [], 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        if end - at <= PIECE + LONG:
            out.append(_of_piece(data[at:end]))
        else:  # the word over the piece's end is a long one
            last = len(data[at : at + PIECE]) - len(_GAP.split(data[at : at + PIECE])[-1])
            out += [_of_piece(data[at : at + last]), np.array([_of_long(data[at + last : end])], np.uint64)]
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, repeats included; fewer words are one run."""
    if not len(words):
        return words
    n = max(len(words) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out += words[j : j + n] * np.uint64(xxhash.xxh64_intdigest(b"%d" % j, SEED) | 1)
    return _mixed(out)
