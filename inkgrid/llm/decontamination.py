"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of every training token. A row of the index is a segment: whole
documents of some two megabytes of text with their terms, and for each term the places where it
stands. Places number the words of the segment, with a gap after each document, so no match
crosses documents. A query is answered segment by segment, where its postings lie, and nothing of
the corpus is shuffled: a window of benchmark words whose terms are not all in the segment is out at
once; for the others the list of the rarest term, moved by the term's offset in the window, is
intersected with the next rarest, and so on (exact phrases), or every term has to stand near it
(proximity). Benchmarks of any size are asked in blocks of bounded size.

Terms are compared as strings between index and benchmark; inside a segment equal words are put
together by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.tables import dropped
from inkgrid.llm.bytescan import ALNUM, LOWER, Chunk, chunks, prefix_hash, span_hash, words
from inkgrid.llm.shared import batches_of, materialise

WINDOW = 10
#: Text bytes of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 21
#: Segments of an Arrow batch.
SEGMENTS = 2
#: Bytes of a row group of the index, or one segment. Parquet asks for its size after a hundred rows only, unless told, and a reader
#: unpacks a whole row group: a task would hold a hundred segments twice over.
ROW_GROUP = 1 << 23
#: Empty places after each document, and so the widest span of a proximity match.
GAP = 64
#: Words that the query asks a proximity match to fit into, for a window of ``WINDOW`` words.
NEAR = 20
#: Windows of a piece of a benchmark item, and words that a block of pieces may hold (it is broadcast).
PIECE, BLOCK = 4096, 1 << 18
#: Candidate places that are intersected at a time.
STEP = 1 << 20


def _gathered(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.StringArray:
    """The spans ``[first, last)`` as an Arrow array."""
    length = last - first
    ends = np.cumsum(length)
    at = np.repeat(first - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[at])))


def _postings(chunk: Chunk) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their counts and places term by term, first place and number of words of each document."""
    lowered = LOWER[chunk.buf]
    first, last, row = words(chunk, ALNUM)
    n_words = np.bincount(row, minlength=chunk.rows)
    starts = np.cumsum(n_words) - n_words + GAP * np.arange(chunk.rows)
    hashes = span_hash(prefix_hash(lowered), first, last)
    order = np.argsort(hashes, kind="stable")
    new = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0)
    places = (order + GAP * row[order]).astype("<i4")
    return _gathered(lowered, first[order[new]], last[order[new]]), np.diff(np.append(new, len(order))), places, starts, n_words


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written index of every word of every whole text: segment, terms, counts, places (4 bytes each), doc_ids, starts, n_words.

    A null text has no words. Documents are told apart by segment and position, so rows of equal or
    null ids are kept apart. Other columns are not read.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in chunks(batch.column(1), SEGMENT):
                terms, counts, places, starts, n_words = _postings(chunk)
                row = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t) if isinstance(a, np.ndarray) else a)
                ids = batch.column(0).slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()), row(terms, None), row(counts, pa.int32()), pa.array([places.tobytes()], pa.binary()), row(ids, None), row(starts, pa.int32()), row(n_words, pa.int32())],
                    ["segment", "terms", "counts", "places", "doc_ids", "starts", "n_words"],
                )
                segment += 1

    schema = f"segment long, terms array<string>, counts array<int>, places binary, doc_ids array<{kind}>, starts array<int>, n_words array<int>"
    return materialise(documents.select(doc_id, text).mapInArrow(run, schema), "postings", **{"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1"})


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Written table of item words, long items in pieces that overlap by a window less one word: item, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                first, last, row = words(chunk, ALNUM)
                every, lowered = _gathered(LOWER[chunk.buf], first, last), np.searchsorted(row, np.arange(chunk.rows + 1))
                cuts = [(r, a, min(a + PIECE + window - 1, lowered[r + 1])) for r in range(chunk.rows) for a in range(lowered[r], max(lowered[r + 1] - window + 1, min(lowered[r] + 1, lowered[r + 1])), PIECE)]
                if cuts:
                    rows, begin, end = (np.array(x) for x in zip(*cuts, strict=True))
                    taken = pa.concat_arrays([every.slice(a, b - a) for a, b in zip(begin, end, strict=True)])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]), pa.int32()), taken)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(rows)), lists], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    return materialise(rows.mapInArrow(run, "item string, words array<string>"), "benchmark-pieces")


@dataclass
class Block:
    """Distinct windows of some pieces as numbers of ``vocabulary``, filled up with -1, and the items of each window."""

    vocabulary: pa.Array
    windows: np.ndarray
    owner: np.ndarray  # window of each (window, item) pair, ascending
    item: np.ndarray
    items: list[str | None]

    @classmethod
    def of(cls, pieces: pa.Table, window: int) -> Block:
        lists = pieces["words"].combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        words, lengths = coded.indices.to_numpy().astype(np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        items, which = np.unique([x or "" for x in pieces["item"].to_pylist()], return_inverse=True)
        # A null item keeps its windows, under a number of its own.
        which = np.where(pc.is_null(pieces["item"]).to_numpy(zero_copy_only=False), len(items), which)
        begin = np.cumsum(lengths) - lengths
        n = np.maximum(lengths - window + 1, 1)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        upto = np.repeat(begin + lengths, n)
        place = at[:, None] + np.arange(window)
        rows = np.where(place < upto[:, None], words[np.minimum(place, len(words) - 1)], -1)
        distinct, number = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(number.ravel() * (len(items) + 1) + np.repeat(which, n))
        return cls(coded.dictionary, distinct, *np.divmod(pairs, len(items) + 1), [*items.tolist(), None])


class Postings:
    """The postings of a segment that a block of windows needs."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, places: np.ndarray, block: Block) -> None:
        known = pc.index_in(terms, value_set=block.vocabulary).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(~np.isnan(known.astype(float)))
        number = np.full(len(block.vocabulary) + 1, -1)
        number[known[mine].astype(int)] = np.arange(len(mine))
        local = number[block.windows]
        self.window = np.flatnonzero(((local >= 0) | (block.windows < 0)).all(1))
        local = np.where(block.windows[self.window] < 0, -1, local[self.window])
        self.n = counts[mine]
        before = np.cumsum(counts) - counts
        self.begin = np.cumsum(self.n) - self.n
        #: Term above place: ascending, so one search finds any place of any term.
        self.keys = np.repeat(np.arange(len(mine)), self.n) << 32
        if len(mine):
            self.keys |= places[np.repeat(before[mine] - self.begin, self.n) + np.arange(self.n.sum())]
        often = np.where(local < 0, np.iinfo(np.int64).max, self.n[local] if len(mine) else 0)
        #: Offsets of a window's words, the rarest first, and their terms; -1 after the last word.
        self.offset = np.argsort(often, axis=1, kind="stable")
        self.term = np.take_along_axis(local, self.offset, axis=1)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and places of their rarest terms, ``STEP`` or one window at a time."""
        n = self.n[self.term[:, 0]] if len(self.window) else np.zeros(0, int)
        total, low = np.cumsum(n), 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + STEP, "right")))
            w = np.repeat(np.arange(low, high), n[low:high])
            inside = np.arange(len(w)) - np.repeat(np.cumsum(n[low:high]) - n[low:high], n[low:high])
            yield w, self.keys[self.begin[self.term[w, 0]] + inside] & 0xFFFFFFFF
            low = high

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and places where their words stand consecutively."""
        for w, place in self.steps():
            start = place - self.offset[w, 0]
            for k in range(1, self.term.shape[1]):
                term = self.term[w, k]
                key = (term << 32) + start + self.offset[w, k]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                here = (term < 0) | (self.keys[at] == key)
                w, start = w[here], start[here]
                if not len(w):
                    break
            yield self.window[w], start

    def near(self, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and places of their rarest word around which all their words stand within ``span`` consecutive words, in any order.

        Bit ``b`` of a mask stands for the stretch that begins ``b`` words before that place.
        """
        full = np.uint64((1 << span) - 1)
        for w, place in self.steps():
            mask = np.full(len(w), full)
            for k in range(1, self.term.shape[1]):
                term, held = self.term[w, k], np.zeros(len(w), np.uint64)
                held[term < 0] = full
                live = np.flatnonzero(term >= 0)
                at = np.searchsorted(self.keys, (term[live] << 32) + np.maximum(place[live] - span + 1, 0))
                while len(live):
                    good = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term[live] << 32) + place[live] + span - 1)
                    live, at = live[good], at[good]
                    ahead = (self.keys[at] & 0xFFFFFFFF) - place[live]
                    held[live] |= np.where(ahead > 0, full >> np.maximum(ahead, 0).astype(np.uint64), (full << np.maximum(-ahead, 0).astype(np.uint64)) & full)
                    at = at + 1
                mask &= held
                w, place, mask = w[mask > 0], place[mask > 0], mask[mask > 0]
                if not len(w):
                    break
            yield self.window[w], place


def _owned(block: Block, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window, place and item of each match, one row for each item that has the window."""
    low, high = np.searchsorted(block.owner, window, "left"), np.searchsorted(block.owner, window, "right")
    n = high - low
    pair = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(window, n), np.repeat(place, n), block.item[pair]


def _merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """By document and item, the spans that matches cover together."""
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    group = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    reach = np.maximum.accumulate(end + (group << 32)) - (group << 32)
    begins = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])]))
    stops = reach[np.append(begins[1:], len(start)) - 1]
    for g in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(group[begins])) + 1):
        k = begins[g[0]]
        yield int(doc[k]), int(item[k]), [(int(start[begins[j]]), int(stops[j])) for j in g]


MATCHES = "segment long, place int, item string, spans array<struct<start: int, end: int>>, near boolean"


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = NEAR) -> DataFrame:
    """Documents (segment, and place in it) by benchmark item: spans of words that exact windows cover, and whether a window is near.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. It is near
    where its words stand within ``near`` consecutive words of a document in any order (at most
    ``GAP``; None: not asked). A null item id stays null.
    """
    if near is not None and not window <= near <= GAP - 1:
        raise ValueError(f"near must lie between the window and {GAP - 1}")
    spark, pieces = index.sparkSession, _pieces(benchmark, window)
    total, blocks = pieces.agg(F.sum(F.size("words"))).first()[0] or 0, 1
    blocks += 2 * total // BLOCK
    place = lambda n: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    while total and pieces.groupBy(place(blocks)).agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] > BLOCK + PIECE + window:
        blocks *= 2

    def asked(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    starts = batch.column("starts")[i].values.to_numpy()
                    found = Postings(batch.column("terms")[i].values, batch.column("counts")[i].values.to_numpy().astype(np.int64), np.frombuffer(batch.column("places")[i].as_buffer(), "<i4").astype(np.int64), block)
                    rows: dict[tuple[int, int], list] = {}
                    exact = [_owned(block, *x) for x in found.phrases()]
                    if exact:
                        w, at, item = (np.concatenate(x) for x in zip(*exact, strict=True))
                        doc = np.searchsorted(starts, at, "right") - 1
                        length = (block.windows[w] >= 0).sum(1)
                        if len(w):
                            rows = {(d, k): [spans, False] for d, k, spans in _merged(doc, item, at - starts[doc], at - starts[doc] + length)}
                    for x in found.near(near) if near else ():
                        _, at, item = _owned(block, *x)
                        for d, k in np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, item]), axis=1).T.tolist():
                            rows.setdefault((d, k), [[], True])[1] = True
                    if rows:
                        segment = batch.column("segment")[i].as_py()
                        yield pa.RecordBatch.from_pylist([{"segment": segment, "place": d, "item": block.items[k], "spans": [{"start": a, "end": b} for a, b in spans], "near": is_near} for (d, k), (spans, is_near) in sorted(rows.items())], schema)

        return run

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("item", pa.string()), ("spans", pa.list_(span)), ("near", pa.bool_())])
    found = []
    for b in range(blocks) if total else ():
        table = pieces.where(place(blocks) == b).toArrow()
        if table.num_rows:
            shared = spark.sparkContext.broadcast(Block.of(table, window))
            # A segment is some megabytes: a batch of all segments of a task would be a hundred.
            with batches_of(spark, SEGMENTS):
                found.append(materialise(index.select("segment", "terms", "counts", "places", "starts").mapInArrow(asked(shared), MATCHES), "matches"))
            shared.unpersist()
    dropped(pieces)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCHES)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated, n_near.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items of such
    windows, ``n_near`` the items with a window near by. An item without an id is hit like others but
    not counted or listed; items of one id count as one. Null or empty texts and items have no words; rows that
    repeat are answered each; empty tables give no rows, or no hits; other columns are not read.
    """
    index = build_index(documents)
    found = matches(index, benchmark, window, near)
    # Spans of all items of a document in one list: how many words they cover together.
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    covered = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), step, lambda acc: acc["n"])
    hits = found.groupBy("segment", "place").agg(
        covered.alias("n_hit"),
        F.sort_array(F.collect_set(F.when(F.size("spans") > 0, F.col("item")))).alias("items"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("item")))).cast("long").alias("n_near"),
    )
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
    none = F.array().cast("array<string>")
    return docs.join(hits, ["segment", "place"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
