"""Numpy kernels of the suffix-array dedup operator: bucket identifiers and anchors.

A *bucket identifier* of length L at byte position p stands for the string
``text[p:p+L]``.  Identifiers are refined as in bucket-pointer refinement: the
identifier of length 2L at p is made of the identifier of length L at p and the
one at the later offset p+L, and every refined level is reused by the next.
"""

from __future__ import annotations

import numpy as np

#: Length of the q-grams that make the initial buckets (a power of two).
Q = 32
_MASK = np.uint64(0xFFFFFFFF00000000)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)


def _pair(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """The refined identifier of two bucket identifiers at neighbouring offsets."""
    h = left * _MUL[2 * level]
    h += right
    h ^= h >> np.uint64(29)
    h *= _MUL[2 * level + 1]
    h ^= h >> np.uint64(32)
    return h


def qgram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of all q-grams of a byte array."""
    h, size, level = _TABLE[data], 1, 0
    while size < Q:
        h = _pair(h[:-size], h[size:], level)
        size, level = size * 2, level + 1
    return h


def _part_size(length: int) -> int:
    """The largest power of two times Q below a length (Q at least): two such parts cover a string of it."""
    half = Q
    while half * 2 < length:
        half *= 2
    return half


def half_ids(buckets: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the two overlapping parts of strings of ``length`` bytes (Q or more) at some positions."""
    half = _part_size(length)
    return bucket_at(buckets, at, half), bucket_at(buckets, at + (length - half), half)


def bucket_at(buckets: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of length ``length`` (Q or more) at some positions, refined from the q-gram buckets."""
    if length <= Q:
        return buckets[at]
    return _pair(*half_ids(buckets, at, length), 6 + (_part_size(length) // Q).bit_length())


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (block prefix and suffix minima)."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, window: int, first: int = 0, last: int | None = None):
    """Anchors of all windows of ``window`` bytes of some concatenated texts.

    ``ends`` are the texts' ends in ``data``.  Each window that lies in one text
    has as its anchor the leftmost of its q-grams with the least identifier, so
    equal windows have equal anchors at equal offsets.  Windows that start in
    [first, last) count.  Returns the buckets of the q-grams and arrays (text,
    anchor, first window, last window), one element for each anchor, sorted.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return np.zeros(0, np.uint64), none, none, none, none
    buckets = qgram_buckets(data)
    key = (buckets & _MASK) | np.arange(len(buckets), dtype=np.uint64)
    at = (_sliding_min(key, window - Q + 1) & ~_MASK).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(ends, starts, side="right")
    good = starts + window <= ends[np.minimum(text, len(ends) - 1)]
    good &= starts >= first
    if last is not None:
        good &= starts < last
    starts, at, text = starts[good], at[good], text[good]
    if not len(starts):
        return buckets, none, none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return buckets, text[new], at[new], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
