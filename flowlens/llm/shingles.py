"""Hashes of word shingles, worked out on whole texts with numpy.

Words are runs of non-white-space after lower-casing A-Z. A text's set holds the 64-bit hashes of its distinct runs of
``k`` words; a shorter text counts as one shingle, a text without words has an empty set.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0], _powers[1]


def _segment_words(raw: np.ndarray) -> np.ndarray:
    white = np.ones(len(raw) + 2, dtype=np.int8)
    white[1:-1] = _WHITE[raw]
    edge = np.flatnonzero(np.diff(white))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _tables(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in order; long texts go by segments that end at white space."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) <= _SEGMENT:
        return _segment_words(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + _SEGMENT, len(raw))
        while end < len(raw) and not _WHITE[raw[end]]:
            gap = np.flatnonzero(_WHITE[raw[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(end + 4096, len(raw))
        parts.append(_segment_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    got = words[: n - size + 1].copy()
    for j in range(1, size):
        got = mix(got + _U(j)) + words[j : n - size + 1 + j]
    return np.unique(mix(got + _U(size)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))
