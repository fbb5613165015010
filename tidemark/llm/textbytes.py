"""Vectorised UTF-8 helpers for Arrow batches.

Texts stay bytes: every routine works on one uint8 array holding a few megabytes of
concatenated texts plus the offsets at which each text begins, so that cost per byte is
that of a handful of numpy passes and memory is bounded by the chunk, except that one
text longer than a chunk is a chunk of its own (texts are never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_STEP = 1 << 12


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with about ``limit`` bytes each, whole texts only."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true for the byte values in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = word_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = word_table((0, 8), (0x0E, 0x1F), (0x21, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the maximal runs of flagged bytes; runs never cross texts."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    ends[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) from two short tables, made for the call: nothing stays in the worker."""
    low = np.full(min(n, _STEP), base, np.uint64)
    low[:1] = 1
    low = np.cumprod(low)
    high = np.full(-(-n // _STEP), pow(base, _STEP, 1 << 64), np.uint64)
    high[:1] = 1
    return np.multiply.outer(np.cumprod(high), low).ravel()[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = _powers(_INVERSE, n)
    terms *= data.astype(np.uint64) + np.uint64(1)
    np.cumsum(terms, out=sums[1:])
    del terms
    raw = sums[ends] - sums[starts]
    raw *= _powers(_MULTIPLIER, n + 1)[starts]
    raw += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(raw)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and the number of words of each text."""
    if lower:
        data = LOWER[data]
    starts, ends, counts = spans(data, offsets, table)
    return span_hashes(data, starts, ends), starts, ends, counts


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values; empty groups give 0."""
    totals = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=totals[1:])
    edges = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=edges[1:])
    return totals[edges[1:]] - totals[edges[:-1]]
