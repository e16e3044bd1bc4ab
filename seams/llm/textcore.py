"""Vectorised work on UTF-8 bytes: word bounds, 64-bit word and shingle hashes.

Texts stay byte buffers; numpy walks a block of documents at a time, so memory
is bounded by BLOCK (or by one text, where a text is longer) and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_TABLE = mix((np.arange(1, 257, dtype=U)) * _GOLD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0:48] = NOT_ALNUM[58:97] = NOT_ALNUM[123:128] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about `size` bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses rows."""
    inside = ~separators[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hashes` gets the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; those that cross rows are the caller's to drop."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_BASE) + h[j : j + n]
    return mix(out + U(k))


def word_hashes(data: np.ndarray, off: np.ndarray, separators: np.ndarray, lower: bool = True):
    """(hashes, start, end, row) of the words."""
    if lower:
        data = LOWER[data]
    start, end, row = words(data, off, separators)
    return span_hashes(sums(data), start, end), start, end, row


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """First word of each of n rows, and the number of words."""
    return np.searchsorted(row, np.arange(n + 1))
