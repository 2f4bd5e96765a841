"""Hashes of words, lines and word shingles for whole batches of texts at once.

A span of bytes is hashed as a polynomial in an odd base modulo 2^64 over random byte values; prefix
sums give every span in two look-ups. Results are mixed, so equal hashes mean equal spans but for
chance of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply and shift rounds)."""
    x = np.array(x, dtype=_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + mix(np.array([seed], _U)))


_BYTE = seeded(11, 256)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the next batch."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, _U)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


class SpanHasher:
    """Hashes of any spans of one byte buffer."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(_U) * _U(_BASE))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than ASCII white space."""
    return _runs(~_SPACE[buf], buf, offsets)


def _runs(inside, buf, offsets):
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | cut[:-1]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every line that is not empty."""
    return _runs(buf != 10, buf, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    start, end, doc = words(buf, offsets)
    return SpanHasher(buf).spans(start, end), doc


def shingles(
    hashes: np.ndarray, doc: np.ndarray, size: int, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words.

    With ``short`` a text of fewer words, but one at least, has one shingle of all its words.
    """
    n = len(hashes) - size + 1
    weight = seeded(29, size)
    if n > 0:
        total = np.zeros(n, _U)
        for j in range(size):
            total += hashes[j : j + n] * weight[j]
        whole = doc[:n] == doc[size - 1 :]
        out, owner = mix(total[whole]), doc[:n][whole]
    else:
        out, owner = np.zeros(0, _U), np.zeros(0, np.int64)
    if short and len(hashes):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        few = count < size
        if few.any():
            sums, at, left = np.zeros(few.sum(), _U), first[few], count[few]
            for j in range(size - 1):
                has = left > j
                sums[has] += hashes[at[has] + j] * weight[j]
            extra = mix(sums + left.astype(_U))
            order = np.argsort(np.r_[owner, doc[at]], kind="stable")
            out, owner = np.r_[out, extra][order], np.r_[owner, doc[at]][order]
    return out, owner


def distinct(
    hashes: np.ndarray, doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs in order of text and hash, and how often each occurs."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    if len(h) == 0:
        return h, d, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return h[first], d[first], np.diff(np.r_[first, len(h)])
