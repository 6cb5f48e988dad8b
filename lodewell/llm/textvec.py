"""Words, lines and hashes of many texts at once, as NumPy arrays over their UTF-8 bytes.

Hashes are of whole strings: a prefix sum of mixed byte codes times powers of an odd
base (all modulo 2**64), so the hash of any span is two look-ups.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, _U)
_INV = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(1, 257, dtype=_U))
#: Bytes that end words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for base, at in ((_BASE, 0), (inverse, 1)):
            p = np.full(size, base, _U)
            p[0] = 1
            np.cumprod(p, out=p)
            if at:
                _INV = p
            else:
                _POW = p
    return _POW[:n], _INV[:n]


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(_CODE[data] * power[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw ^ mix((end - start).astype(_U)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document of each) of the words `[^\\x20\\x09-\\x0D]+` of texts laid end to end."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    inside = ~SEPARATOR[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins[offsets[-1]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.diff(np.append(np.searchsorted(s, offsets[:-1]), len(s)))
    return s, e, np.repeat(np.arange(len(counts)), counts)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document of each) of all pieces between line feeds; a text has one more than it has line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:] - 1
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
        ends[last] = offsets[doc[last] + 1]
    return starts, ends, doc


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of all runs of k words within one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    total = np.zeros(n, _U)
    for i in range(k):
        total += mix(hashes[i : i + n] + _U(i * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(total[at])


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between offsets, also where documents are empty."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
