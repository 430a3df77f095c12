"""Periodic runs of words, and texts without their repeats.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 2 q)`` long, that no
neighbouring word extends. Every word of a run stands in it twice or more. So each text is split at the words that
occur only once in their segment, counts are taken anew within the pieces, and pieces split again
until nothing changes; pieces shorter than ``LEAST`` are out. The few that survive are scanned by
lag: a run of period q holds q consecutive pairs of equal words q apart, one of which begins at a
multiple of q, so for lag q only every q-th word is compared with the word q ahead
(n log n comparisons a segment). From equal samples the stretch of equal pairs is measured to both
sides with prefix hashes. A stretch found with several lags has the smallest of them as its period.

Equal words are told by 64-bit hashes. Texts are worked on where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkgrid.llm.bytescan import MULTIPLIER, NON_SPACE, Chunk, chunks, mix, prefix_hash, span_hash, words
from inkgrid.llm.shared import unused

LEAST = 12
#: Samples that are compared at a time.
STEP = 1 << 20


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``n[i]`` of them, for each ``i``."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def segments(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the stretches that may hold runs, in order.

    ``row`` numbers the texts, ascending. Splitting is a filter only: it never cuts through a run.
    """
    at, owner = np.arange(len(hashes)), row.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        key = mix(hashes[at] + owner.astype(np.uint64) * np.uint64(MULTIPLIER))
        order = np.argsort(key)
        same = np.concatenate([[False], np.diff(key[order]) == 0, [False]])
        often = np.empty(len(at), bool)
        often[order] = same[1:] | same[:-1]
        # A new piece begins after a rare word and at each old one's begin.
        begins = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
        whole = np.logical_and.reduceat(often, begins)
        sizes = np.diff(np.append(begins, len(at)))
        done.append((at[begins[whole]], sizes[whole]))
        open_ = np.repeat(~whole, sizes)
        at, owner, often = at[open_], owner[open_], often[open_]
        piece = np.cumsum((np.diff(owner, prepend=-1) != 0) | ~often | np.concatenate([[False], ~often[:-1]]))[often]
        at = at[often]
        if len(at):
            n = np.bincount(piece)
            long = n[piece] >= LEAST
            at, owner = at[long], piece[long]
    first, size = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    order = np.argsort(first)
    order = order[size[order] >= LEAST]
    return first[order], size[order]


class Stretches:
    """Prefix hashes over the words of some segments laid end to end."""

    def __init__(self, words: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.power = np.full(len(words) + 1, MULTIPLIER, np.uint64)
            self.power[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power[:-1])])

    def equal(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` on equal those ``q`` further on."""
        with np.errstate(over="ignore"):
            return (self.prefix[a + n] - self.prefix[a]) * self.power[q] == self.prefix[a + q + n] - self.prefix[a + q]

    def reach(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many consecutive pairs of words ``q`` apart are equal, from ``a`` on or before ``a``; at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            n = (low + high + 1) // 2
            good = self.equal(a - n if back else a, q, n)
            low, high = np.where(good, n, low), np.where(good, high, n - 1)
        return low


def _scanned(found: Stretches, h: np.ndarray, begin: np.ndarray, size: np.ndarray, seg: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of equal pairs for the given segments and lags: first word, length, lag."""
    n = (size[seg] - 1) // q
    pair = np.repeat(np.arange(len(seg)), n)
    lag = q[pair]
    at = begin[seg[pair]] + _ranges(np.zeros(len(n), np.int64), n) * lag
    hit = h[at] == h[at + lag]
    pair, lag, at = pair[hit], lag[hit], at[hit]
    # Samples of one stretch follow each other: measured from the first backwards, from the last onwards.
    tied = (pair[1:] == pair[:-1]) & (at[1:] - at[:-1] == lag[1:])
    tied[tied] = found.equal(at[:-1][tied], lag[1:][tied], lag[1:][tied])
    head, tail = np.flatnonzero(np.append(True, ~tied)[: len(at)]), np.flatnonzero(np.append(~tied, True)[: len(at)])
    lag, seg = lag[head], seg[pair[head]]
    low = at[head] - found.reach(at[head], lag, at[head] - begin[seg], True)
    high = at[tail] + found.reach(at[tail], lag, begin[seg] + size[seg] - lag - at[tail], False)
    good = (high - low >= lag) & (high - low + lag >= LEAST)
    return low[good], (high - low + lag)[good], lag[good]


def find_runs(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (over all texts), length and period of every run, in order of first word and period."""
    first, size = segments(hashes, row)
    place = _ranges(first, size)
    h, begin = hashes[place], np.cumsum(size) - size
    found = Stretches(h)
    lags = size // 2
    parts = []
    samples, low = np.cumsum(size * (1 + np.log(np.maximum(lags, 1)))), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(samples, (samples[low - 1] if low else 0) + STEP, "right")))
        seg = np.repeat(np.arange(low, high), lags[low:high])
        q = _ranges(np.ones(high - low, np.int64), lags[low:high])
        # One long segment alone is scanned some lags at a time.
        n = np.cumsum((size[seg] - 1) // q)
        a = 0
        while a < len(seg):
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + STEP, "right")))
            parts.append(_scanned(found, h, begin, size, seg[a:b], q[a:b]))
            a = b
        low = high
    start, length, period = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[: len(start)]
    start, length, period = place[start[smallest]] if len(start) else start, length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(chunk: Chunk, first: np.ndarray, last: np.ndarray, row: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    first, last, row = first[kept], last[kept], row[kept]
    buf, edge = chunk.buf.copy(), np.zeros(len(chunk.buf) + 1, np.int8)
    edge[first] += 1
    edge[last] -= 1
    taken = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    after = last[:-1][row[1:] == row[:-1]]
    taken[after], buf[after] = True, 0x20
    return [buf[a:b][taken[a:b]].tobytes() for a, b in zip(chunk.starts, chunk.ends, strict=True)]


def periodic_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` without ``text``, and n_words, runs (start, length, period in words; by start, then period), collapsed.

    ``collapsed`` are the words that no run contains after its first period, joined by one space. A
    null text has no words; an empty table stays empty; other columns, and rows that repeat, stay as
    they are; a new column whose name is taken gets underscores.
    """
    others = [c for c in documents.columns if c != text]
    names = [unused(others, c) for c in ("n_words", "runs", "collapsed")]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                first, last, row = words(chunk, NON_SPACE)
                start, length, period = find_runs(span_hash(prefix_hash(chunk.buf), first, last), row)
                gone = np.zeros(len(first) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                texts = _collapsed(chunk, first, last, row, np.cumsum(gone[:-1]) == 0)
                n_words = np.bincount(row, minlength=chunk.rows)
                owner = row[start]
                before = (np.cumsum(n_words) - n_words)[owner]
                offsets = pa.array(np.searchsorted(owner, np.arange(chunk.rows + 1)), pa.int32())
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - before, length, period)], fields=list(run_type))
                new = [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.binary()).cast(pa.string())]
                kept = [batch.column(i + 1).slice(chunk.first, chunk.rows) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*others, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in others]).schema.fields]
    new = [f"{names[0]} long", f"{names[1]} array<struct<start: long, length: long, period: long>>", f"{names[2]} string"]
    return documents.select(text, *[f"`{c}`" for c in others]).mapInArrow(run, ", ".join([*kinds, *new]))
