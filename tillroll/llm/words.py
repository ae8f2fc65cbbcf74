"""Hashes of words and of word sequences, whole texts at a time in numpy.

Words are runs of bytes other than ASCII white space, with A to Z in small letters. A hash has
64 bits; two different words or sequences share one with a chance of about 5e-20.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Value of a byte inside a word: small letters for capital ones, 0 for white space.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[_SPACE] = 0
_POWERS = np.ones(1 << 16, np.uint64)
_POWERS[1:] = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(_POWERS)
#: Bytes worked on at once; a longer word makes its piece longer.
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    terms = _VALUE[raw[starts[0] :]] * _POWERS[place & 0xFFFF]
    sums = np.add.reduceat(terms, starts - starts[0])
    lengths = np.add.reduceat(inside[starts[0] :].astype(np.uint64), starts - starts[0])
    return mix(sums + mix(lengths))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of the text, in order; none for null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= _PIECE:
        return _hashes(np.frombuffer(data, np.uint8))
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            gap = np.flatnonzero(_SPACE[raw[end : end + _PIECE]])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + _PIECE)
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of `size` neighbouring words; the whole sequence as one if it is shorter; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mix(total) + words[i : len(words) - size + 1 + i] * np.uint64(0xD6E8FEB86659FD93)
    return mix(total)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of `sequence_hashes`, ascending."""
    return np.unique(sequence_hashes(word_hashes(text), size))
