"""Vectorised scans of Arrow string columns as raw UTF-8 bytes.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes (a longer text is a chunk of its
own), so memory is bounded by the longest text and not by the rows of a batch. Inside a chunk all
texts lie one after the other in one byte array; ``starts`` and ``ends`` delimit them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: One random 64-bit value per byte.
BYTE_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: Bytes of words that white space separates: all but x20 and x09 to x0D.
NON_SPACE = ~_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of letters and digits: ASCII letters, digits, and every byte of a non-ASCII character.
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Chunk:
    first: int  # row of the batch that the chunk begins with
    rows: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of(self, positions: np.ndarray) -> np.ndarray:
        """The row in the chunk that each byte position lies in."""
        return np.searchsorted(self.ends, positions, side="right")


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Whole texts of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        stop = min(stop, n, row + 50_000)
        base = at[row]
        yield Chunk(row, stop - row, raw[base : at[stop]], at[row:stop] - base, at[row + 1 : stop + 1] - base)
        row = stop


def words(chunk: Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``table`` bytes; runs never cross texts."""
    n = len(chunk.buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = table[chunk.buf]
    edge = np.zeros(n + 1, bool)
    edge[chunk.starts] = True
    edge[chunk.ends] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1, chunk.of(first)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, MULTIPLIER, np.uint64)
        down = np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any span."""
    size = 1 << max(20, int(len(buf)).bit_length())
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * _powers(size)[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``[first, last)``; equal bytes give equal hashes wherever they stand."""
    size = 1 << max(20, int(len(prefix) - 1).bit_length())
    return mix((prefix[last] - prefix[first]) * _powers(size)[1][first] + (last - first).astype(np.uint64))


def gram_hashes(prefix: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """``span_hash`` of the spans of ``size`` bytes that begin at ``low``, ``low + 1`` and so on and end at ``high`` at most."""
    stop = high - size + 1
    powers = _powers(1 << max(20, int(len(prefix) - 1).bit_length()))[1][low:stop]
    return mix((prefix[low + size : stop + size] - prefix[low:stop]) * powers + np.uint64(size))


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each tuple of hashes, sensitive to their order."""
    out = np.zeros_like(hashes[0])
    for h in hashes:
        out = out * np.uint64(MULTIPLIER) + h
    return mix(out)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Integer sums of ``values`` by row."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def keyed(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sortable keys: the row above the upper 48 bits of the hash (a chunk has at most 50,000 rows)."""
    return (rows.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
