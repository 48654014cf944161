"""Hashes of words, word windows and byte ranges, computed with NumPy inside tasks.

A range is hashed as a polynomial of its bytes modulo 2^64 and then mixed, so equal ranges have equal
hashes wherever they stand, and all ranges of a text cost one running sum. Separators are the space
and the bytes 09-0D, which in UTF-8 are never part of another character.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
CHUNK = 1 << 18

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_blank = np.zeros(256, bool)
_blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2^64 for ``i < n`` (at least)."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _tables[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def forget() -> None:
    """Drop the tables of powers; they are made anew when wanted."""
    _tables.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, max(1, len(values)))[0][: len(values)], out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of the ranges ``[start, end)`` from ``running``."""
    h = (prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators."""
    if len(text) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(text) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_blank[text], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words. Long texts are worked on in pieces of a quarter of a megabyte."""
    starts, ends = word_bounds(text)
    if len(text) <= CHUNK:
        if len(starts) == 0:
            return np.zeros(0, np.uint64), starts, ends
        values = text.astype(np.uint64) + np.uint64(1)
        return ranges(running(values, BYTE_BASE), starts, ends, BYTE_BASE), starts, ends
    hashes, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        low, high = starts[first], ends[last - 1]
        values = text[low:high].astype(np.uint64) + np.uint64(1)
        part = slice(first, last)
        hashes[part] = ranges(running(values, BYTE_BASE), starts[part] - low, ends[part] - low, BYTE_BASE)
        first = last
    return hashes, starts, ends


def windows(hashes: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return ranges(running(hashes, base), starts, starts + size, base)


def lower(text: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    upper = (text >= 65) & (text <= 90)
    return text + (upper.view(np.uint8) << 5) if upper.any() else text
