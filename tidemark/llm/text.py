"""Vectorised views of UTF-8 text: words, word hashes, n-gram hashes, window minima.

Everything works on a chunk: the bytes of several whole texts side by side and the
offsets where each begins, as Arrow keeps them, so no Python string is built per word.
A word is a run of ASCII digits, lower-cased ASCII letters and bytes of non-ASCII
characters; that is the character class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z
are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[0x80:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when a longer text comes."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 16 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


@dataclass
class Chunk:
    """Rows low..high of a column: their bytes, and bounds[i]..bounds[i+1] for row low+i."""

    low: int
    high: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[Chunk]:
    """A string or binary column in runs of whole rows of about ``limit`` bytes, and of at most ``rows`` rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if pa.types.is_null(column.type):
        yield Chunk(0, n, np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, n, low + (rows or n))
        yield Chunk(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Words of a chunk, in order: row i has words first[i]..first[i+1]."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end; a run ends with its row."""
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = bounds[bounds < len(inside)]
    begin[at] = inside[at]
    at = bounds[bounds > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every pair, from one prefix sum."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_P, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_P_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def words(chunk: Chunk) -> Words:
    low = LOWER[chunk.data]
    start, end = spans(IS_WORD[low], chunk.bounds)
    first = np.searchsorted(start, chunk.bounds)
    return Words(first, span_hash(_BYTE[low], start, end), start, end)


def lines(chunk: Chunk) -> Words:
    """Lines that have more than white space, between line feeds; their hashes are of trimmed bytes."""
    data = chunk.data
    n = len(data)
    black = data > 32
    start, end = spans(data != 10, chunk.bounds)
    blacks = np.zeros(n + 1, np.int64)
    np.cumsum(black, out=blacks[1:])
    has = blacks[end] > blacks[start]
    start, end = start[has], end[has]
    at = np.flatnonzero(black)
    trimmed = at[blacks[start]] if len(at) else start
    stop = at[blacks[end] - 1] + 1 if len(at) else end
    return Words(np.searchsorted(start, chunk.bounds), span_hash(_BYTE[data], trimmed, stop), start, end)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for every i; the last k-1 are left out."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= _Q
        total += values[j : j + n]
    return mix(total + np.uint64(k))


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n positions begin k items of one and the same row."""
    ok = np.zeros(n, bool)
    size = np.diff(first)
    use = size >= k
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first[:-1][use], 1)
    np.add.at(step, first[1:][use] - k + 1, -1)
    ok[:] = np.cumsum(step[:-1]) > 0
    return ok


def window_minima(values: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Winnowing: which values are the least of some ``window`` neighbours of their row.

    first: row i has values first[i]..first[i+1]. Of equal minima all are kept.
    A row with fewer values than ``window`` has no window.
    """
    n = len(values)
    keep = np.zeros(n, bool)
    if n < window:
        return keep
    least = values[: n - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, values[j : j + len(least)], out=least)
    ok = whole(first, n, window)[: len(least)]
    for j in range(window):
        keep[j : j + len(least)] |= ok & (values[j : j + len(least)] == least)
    return keep
