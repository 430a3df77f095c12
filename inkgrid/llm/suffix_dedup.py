"""Repeated substrings: bytes covered by strings of ``LENGTH`` bytes that also start in an earlier document.

1. Every string of ``LENGTH`` bytes owns an anchor: of its ``GRAM``-byte grams the one with the
   smallest hash, the first among equals. Neighbouring strings share anchors, so a text falls into
   runs of strings with one anchor, and equal strings have equal anchors at equal offsets. A run's
   bytes are a segment (66 on average, at most 83). Grams that many documents hold, as a bounded
   sample shows, come last in that order: strings that reach beyond a common passage are anchored
   outside it, and those inside it have equal segments.
2. Runs meet by anchor, as hashes only. Copies of one segment collapse: all documents but the first
   lose their whole run. Segments that are frequent in the sample meet as one record a million runs,
   and their first documents, a short list, are sent to every text.
3. Where an anchor has different segments, one copy of each goes on. They are joined to one text;
   its suffix array is built by linear grouping, and strings that share their first ``LENGTH`` bytes
   lie side by side there. Segments of an anchor with more than ``JOINED`` are first cut into runs
   by further minima of their strings, so that every array stays short.
4. Covered runs come back to their documents and are cut out.

Texts are dealt by a hash of the document id, anchors by their hash, into buckets of about
``BUCKET_BYTES`` of text, one a task. Records travel in blobs of at least one, so rows never
outnumber records, and texts stream past the records of their bucket. The sample steers where records
go and nothing else. No pair of documents is ever formed.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.tables import dropped
from inkgrid.llm.bytescan import Chunk, chain, chunks, gram_hashes, mix, prefix_hash, span_hash
from inkgrid.llm.shared import materialise
from inkgrid.llm.suffix_groups import suffix_arrays

LENGTH = 50
GRAM = 18
#: Segments of an anchor up to which they make one text with a suffix array.
JOINED = 8
#: Segments of an anchor up to which whole segments go to its task; beyond, each document sends what ``DEEP`` minima cut.
HOT = 256
DEEP = 4
#: Bytes of text a bucket.
BUCKET_BYTES = 8 << 20
#: Bytes of texts that are dealt to buckets together.
DEALT_BYTES = 32 << 20
#: Documents of the sample that finds frequent grams and segments, in how many of them those stand, and how many are kept.
SAMPLE_DOCUMENTS, FREQUENT, MAX_FREQUENT = 1024, 5, 1 << 17
INDEX_BITS = 24  # positions within a part
SCAN = 1 << 19  # bytes of a chunk
PART = 1 << 16  # strings of a chunk that are looked at together, so that their hashes stay in a processor's cache


class Known:
    """A sorted list of hashes with a bitmap in front of it, for many questions with mostly negative answers."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values.astype(np.uint64))
        self.bits = min(22, max(16, len(self.values).bit_length() + 5))
        self.bitmap: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known hashes, and their places in ``values``."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift = np.uint64(64 - self.bits)
        if self.bitmap is None:
            self.bitmap = np.zeros(1 << self.bits, bool)
            self.bitmap[self.values >> shift] = True
        at = np.flatnonzero(self.bitmap[hashes >> shift])
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        ok = self.values[place] == hashes[at]
        return at[ok], place[ok]


NONE = Known(np.zeros(0, np.uint64))


def runs(chunk: Chunk, length: int = LENGTH, common: Known = NONE) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: row, first and last string start, anchor position, gram hash, segment hash.

    ``common`` grams are anchors only of strings without any other.
    """
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    gram = min(GRAM, length)
    width = length - gram + 1
    n = len(chunk.buf)
    if n < length:
        return empty
    # Parts overlap, so that every string lies in one as a whole; positions within a part fit beside the hash.
    prefix = prefix_hash(chunk.buf)
    low_bits = np.uint64((1 << INDEX_BITS) - 1)
    places, owners, before = [], [], -1
    edges = _edges(chunk, length)
    for low in range(0, n - length + 1, PART):
        high = min(n, low + PART + length - 1)
        key = gram_hashes(prefix, low, high, gram)
        frequent, _ = common.find(key)
        # The low bits hold the position, so that the minimum names its place and the first of equals wins.
        key >>= np.uint64(1)
        key &= ~low_bits
        key |= np.arange(len(key), dtype=np.uint64)
        key[frequent] |= np.uint64(1 << 63)
        least, n_seen = key, 1
        while 2 * n_seen <= width:
            least, n_seen = np.minimum(least[:-n_seen], least[n_seen:]), 2 * n_seen
        if n_seen < width:
            least = np.minimum(least[: len(least) - (width - n_seen)], least[width - n_seen :])
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[0] = int(least[0] & low_bits) + low != before
        new[edges[np.searchsorted(edges, low) : np.searchsorted(edges, low + len(least))] - low] = True
        at = np.flatnonzero(new)
        places.append(at + low)
        owners.append((least[at] & low_bits).astype(np.int64) + low)
        before = int(least[-1] & low_bits) + low
    first, anchor = np.concatenate(places), np.concatenate(owners)
    last = np.append(first[1:], n - length + 1) - 1
    row = chunk.of(first)
    whole = first + length <= chunk.ends[row]
    first, last, anchor, row = first[whole], last[whole], anchor[whole], row[whole]
    if not len(first):
        return empty
    grams = span_hash(prefix, anchor, anchor + gram)
    segments = chain([span_hash(prefix, first, last + length), (anchor - first).astype(np.uint64)])
    return row, first, last, anchor, grams, segments


def _edges(chunk: Chunk, length: int) -> np.ndarray:
    """Where the strings of a text begin, and where what would reach beyond it does."""
    beyond = np.maximum(chunk.ends - length + 1, chunk.starts)
    return np.unique(np.concatenate([chunk.starts, beyond]))


MET = np.dtype([("key", "<u4"), ("seg_low", "<u4"), ("seg_high", "<u2"), ("number", "<u4")])
ASKED = np.dtype([("doc", "<i8"), ("key", "<u4"), ("seg_low", "<u4"), ("seg_high", "<u2"), ("number", "<u4"), ("kind", "u1"), ("bucket", "<u4")])
#: ``text`` is a crc32 of the whole text, as rows of one id may differ.
COVER = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("end", "<u4")])
#: Ahead of each segment's bytes: group, document, its text, start of the segment, length in bytes.
HEAD = np.dtype([("group", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<u4"), ("size", "<u2")])
#: The first document of a frequent segment.
LEAST = np.dtype([("id", "<u8"), ("doc", "<i8")])
DEALT = "bucket int, kind string, data binary"


_ZSTD = pa.Codec("zstd", 3)


def _ipc_options() -> pa.ipc.IpcWriteOptions:
    return pa.ipc.IpcWriteOptions(compression=_ZSTD)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _restored(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], size, asbytes=True) if size else b""


def _packed(records: np.ndarray) -> bytes:
    """Records field by field and compressed: ids and numbers repeat, hashes do not."""
    return _squeezed(b"".join(np.ascontiguousarray(records[n]).tobytes() for n in records.dtype.names))


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    data = _restored(blob)
    out, at = np.empty(len(data) // kind.itemsize, kind), 0
    for n in kind.names:
        out[n] = np.frombuffer(data, kind[n], len(out), at)
        at += out[n].nbytes
    return out


def _by_bucket(bucket: np.ndarray, records: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    edge = [*at.tolist(), len(records)]
    fields = [records[n][order] for n in records.dtype.names]
    yield _blobs(found, kind, [_squeezed(b"".join(f[a:b].tobytes() for f in fields)) for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _blobs(bucket: np.ndarray, kind: str, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int32)), "kind": pa.array([kind] * len(data), pa.string()), "data": pa.array(data, pa.binary())})


def _by_blob(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["bucket"][i].as_py(), batch["kind"][i].as_py(), batch["data"][i].as_py()


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _numbers(row: np.ndarray, rows: int) -> np.ndarray:
    """The number of each run within its text."""
    count = np.bincount(row, minlength=rows)
    return np.arange(len(row)) - (np.cumsum(count) - count)[row]


def _routed(grams: np.ndarray, segments: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Anchor bucket, key in it, the two parts of the segment hash, and one hash of them all."""
    bucket, key = grams % np.uint64(buckets), (grams // np.uint64(buckets)).astype(np.uint32)
    low, high = segments.astype(np.uint32), (segments >> np.uint64(32)).astype(np.uint16)
    return bucket.astype(np.int32), key, low, high, chain([bucket, key.astype(np.uint64), low.astype(np.uint64), high.astype(np.uint64)])


def _frequent(sample: DataFrame, hashes: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]) -> Known:
    """Hashes that at least ``FREQUENT`` of the sampled documents hold, at most ``MAX_FREQUENT`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), SCAN):
                row, found = hashes(chunk)
                order = np.lexsort((row, found))
                row, found = row[order], found[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                value, n = np.unique(found[fresh], return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(value.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return Known(np.array([r[0] for r in counted.orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT).collect()], np.int64).view(np.uint64))


def _meetings(documents: DataFrame, length: int, buckets: int, common: Known, frequent: Known) -> DataFrame:
    """Runs of all documents as hashes, dealt by anchor: a blob is a count, the ids, their runs' counts, the runs.

    Of a frequent segment only the first document of each flush goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, bucket, record, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            at, place = frequent.find(whole)
            if len(at):
                order = np.lexsort((doc[at], place))
                at, place = at[order], place[order]
                keep = np.ones(len(doc), bool)
                same = np.concatenate([[False], place[1:] == place[:-1]])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
                keep[at[doc[at] > doc[at][first]]] = False
                doc, bucket, record = doc[keep], bucket[keep], record[keep]
            order = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[order], return_index=True)
            edge = [*at.tolist(), len(order)]
            doc, record, data = doc[order], record[order], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                new = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
                # Hashes do not compress; what tells where a run stands does.
                own = record[a:b]
                rest = _squeezed(np.array([len(new)], "<i8").tobytes() + doc[a:b][new].tobytes() + np.diff(np.append(new, b - a)).astype("<u4").tobytes() + np.diff(own["number"], prepend=np.uint32(0)).astype("<u4").tobytes())
                data.append(len(own).to_bytes(8, "little") + b"".join(own[n].tobytes() for n in ("key", "seg_low", "seg_high")) + rest)
            return _blobs(found, "met", data)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text"), SCAN):
                row, _, _, _, grams, segments = runs(chunk, length, common)
                record = np.empty(len(row), MET)
                bucket, record["key"], record["seg_low"], record["seg_high"], whole = _routed(grams, segments, buckets)
                record["number"] = _numbers(row, chunk.rows)
                held.append((ids[row + chunk.first].astype("<i8"), bucket, record, whole))
                size += len(row)
                if size >= 500_000:
                    yield flush()
                    held.clear()
                    size = 0
        if size:
            yield flush()

    return documents.mapInArrow(run, DEALT)


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, at = int.from_bytes(blob[:8], "little"), 8
    out = np.empty(size, MET)
    for n in ("key", "seg_low", "seg_high"):
        out[n] = np.frombuffer(blob, MET[n], size, at)
        at += out[n].nbytes
    rest = _restored(blob[at:])
    n = int(np.frombuffer(rest, "<i8", 1)[0])
    docs, counts = np.frombuffer(rest, "<i8", n, 8), np.frombuffer(rest, "<u4", n, 8 + 8 * n)
    out["number"] = np.cumsum(np.frombuffer(rest, "<u4", size, 8 + 12 * n), dtype=np.uint32)
    return np.repeat(docs, counts), out


def _requests(met: DataFrame, buckets: int, frequent: Known) -> DataFrame:
    """What each document is asked for: its runs that an earlier document has too (kind 0), segments to compare (1), what further minima cut of them (2).

    Rows ``least`` have the first document of each frequent segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, bucket = [], 0
        for bucket, _, blob in _by_blob(batches):  # noqa: B007
            opened.append(_opened(blob))
        if not opened:
            return
        doc, rec = np.concatenate([o[0] for o in opened]), np.concatenate([o[1] for o in opened])
        opened.clear()
        if len(frequent.values):
            u = [rec[n].astype(np.uint64) for n in ("key", "seg_low", "seg_high")]
            at, place = frequent.find(chain([np.full(len(rec), bucket, np.uint64), *u]))
            if len(at):
                order = np.lexsort((doc[at], place))
                at, place = at[order], place[order]
                first = np.concatenate([[True], place[1:] != place[:-1]])
                least = np.empty(int(first.sum()), LEAST)
                least["id"], least["doc"] = frequent.values[place[first]], doc[at[first]]
                yield _blobs(np.array([bucket]), "least", [_packed(least)])
        key = rec["key"]
        # Anchors of one document only drop out before anything is sorted by segment.
        order = np.argsort(key, kind="stable")
        key, doc, rec = key[order], doc[order], rec[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        keep = np.repeat(shared, np.diff(np.append(starts, len(key))))
        doc, rec = doc[keep], rec[keep]
        if not len(doc):
            return
        seg = rec["seg_low"].astype(np.uint64) | (rec["seg_high"].astype(np.uint64) << np.uint64(32))
        order = np.lexsort((doc, seg, rec["key"]))
        doc, rec, seg = doc[order], rec[order], seg[order]
        new_key = np.concatenate([[True], rec["key"][1:] != rec["key"][:-1]])
        new = new_key | np.concatenate([[True], seg[1:] != seg[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(doc)))
        later = doc > np.repeat(doc[begin], size)
        group = np.cumsum(new_key) - 1
        classes = np.bincount(group[begin])[group]
        pick = later | (classes > 1)
        out = np.empty(int(pick.sum()), ASKED)
        for name in ("key", "seg_low", "seg_high", "number"):
            out[name] = rec[name][pick]
        out["doc"], out["bucket"] = doc[pick], bucket
        out["kind"] = np.where(later, 0, np.where(classes > HOT, 2, 1))[pick]
        yield from _by_bucket(_doc_bucket(out["doc"], buckets), out, "asked")

    return met.repartitionById(buckets, F.col("bucket")).mapInArrow(run, DEALT)


def _joined(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one of ``size`` bytes or somewhat more: with many buckets what comes from a blob may be a single short text."""
    held, bytes_ = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            bytes_ += batch.nbytes
        if held and (batch is None or bytes_ >= size):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, bytes_ = [], 0


def _opened_texts(blobs: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Documents of neighbouring blobs, a chunk's worth at a time."""
    return _joined((b for blob in blobs for b in pa.ipc.open_stream(blob)), SCAN)


def _dealt_texts(documents: DataFrame, buckets: int) -> DataFrame:
    """Documents by the bucket of their id, as the requests have it: one compressed Arrow stream a bucket and some ``DEALT_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = _ipc_options()
        for batch in _joined(batches, DEALT_BYTES):
            bucket = _doc_bucket(batch.column("doc_id").fill_null(0).to_numpy(), buckets)
            order = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[order], return_index=True)
            edge = [*at.tolist(), len(order)]
            batch, data = batch.take(pa.array(order)), []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                data.append(sink.getvalue().to_pybytes())
            yield _blobs(found, "text", data)

    return documents.select("doc_id", "text").mapInArrow(run, DEALT)


def _beside_texts(records: DataFrame, documents: DataFrame, buckets: int, run: Callable[[Iterator[tuple[int, str, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Records and texts of each bucket in one task; the texts come last and stream by."""
    both = records.unionByName(_dealt_texts(documents, buckets)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")
    return both.mapInArrow(lambda batches: run(_by_blob(batches)), schema)


def _merged(cover: np.ndarray) -> np.ndarray:
    """Unions of touching runs by document."""
    if not len(cover):
        return cover
    cover = cover[np.lexsort((cover["end"], cover["start"], cover["text"], cover["doc"]))]
    # Ends as running maxima within a document: documents are numbered so that a later one lies beyond all before it.
    number = np.cumsum(np.concatenate([[0], (cover["doc"][1:] != cover["doc"][:-1]) | (cover["text"][1:] != cover["text"][:-1])]))
    shift = number << 32
    start, end = cover["start"].astype(np.int64) + shift, np.maximum.accumulate(cover["end"].astype(np.int64) + shift)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    begin = np.flatnonzero(new)
    out = cover[begin].copy()
    out["end"] = end[np.append(begin[1:], len(cover)) - 1] - shift[begin]
    return out


def _together(found: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    return np.concatenate(found) if found else np.zeros(0, kind)


def _answers(asked: DataFrame, documents: DataFrame, length: int, buckets: int, common: Known, least: np.ndarray) -> DataFrame:
    """Covered runs and segments of the documents asked for them; ``least`` covers frequent segments without being asked."""
    frequent = Known(least["id"])
    first_doc = least["doc"][np.argsort(least["id"])]

    def run(blobs: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        asks, waiting, bucket = None, [], 0
        covers: list[np.ndarray] = []
        segs: dict[int, tuple[list[bytes], list[bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            joined = [(b"".join(h), b"".join(d)) for h, d in segs.values()]
            return _blobs(np.array(list(segs)), "segment", [_squeezed(np.array([len(h) // HEAD.itemsize], "<i8").tobytes() + h + d) for h, d in joined])

        def texts() -> Iterator[bytes]:
            nonlocal bucket
            for bucket, kind, blob in blobs:  # noqa: B007
                if kind == "asked":
                    waiting.append(_unpacked(blob, ASKED))
                else:
                    yield blob

        for batch in _opened_texts(texts()):
            if asks is None:
                asks = _together(waiting, ASKED)
                asks = asks[np.lexsort((asks["number"], asks["doc"]))]
                asked_of = np.ascontiguousarray(asks["doc"])
                waiting.clear()
            for own, chunk in ((batch.column("doc_id").slice(c.first, c.rows).to_numpy(), c) for c in chunks(batch.column("text"), SCAN)):
                low, high = np.searchsorted(asked_of, own, "left"), np.searchsorted(asked_of, own, "right")
                if not len(least) and not (high > low).any():
                    continue
                row, first, last, _, grams, segments = runs(chunk, length, common)
                home, key, seg_low, seg_high, whole = _routed(grams, segments, buckets)
                known, place = frequent.find(whole)
                known = known[own[row[known]] > first_doc[place]]
                per = np.bincount(row, minlength=chunk.rows)
                base = np.cumsum(per) - per
                ask_row = np.repeat(np.arange(chunk.rows), high - low)
                ask = asks[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(ask_row))]
                fits = ask["number"] < per[ask_row]
                ask, ask_row = ask[fits], ask_row[fits]
                at = base[ask_row] + ask["number"]
                # Another text under the same id has other runs: only what is the same run is answered.
                same = (home[at] == ask["bucket"]) & (key[at] == ask["key"]) & (seg_low[at] == ask["seg_low"]) & (seg_high[at] == ask["seg_high"])
                ask, at = ask[same], at[same]
                crc = np.zeros(chunk.rows, np.uint32)
                for r in np.unique(np.concatenate([row[at], row[known]])).tolist():
                    crc[r] = zlib.crc32(chunk.buf[chunk.starts[r] : chunk.ends[r]])
                gone = np.concatenate([at[ask["kind"] == 0], known])
                c = np.empty(len(gone), COVER)
                c["doc"], c["text"], c["start"], c["end"] = own[row[gone]], crc[row[gone]], first[gone] - chunk.starts[row[gone]], last[gone] + length - chunk.starts[row[gone]]
                covers.append(_merged(c))
                for deep in (False, True):
                    k = at[ask["kind"] == 1 + deep]
                    if not len(k):
                        continue
                    head = np.empty(len(k), HEAD)
                    head["group"], head["doc"], head["text"] = grams[k], own[row[k]], crc[row[k]]
                    head["start"], head["size"] = first[k] - chunk.starts[row[k]], last[k] - first[k] + length
                    f = first[k]
                    if deep:
                        head, f = cut_deeper(head, chunk.buf, f, DEEP, length)
                    n = head["size"].astype(np.int64)
                    target = (head["group"] % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(target, kind="stable")
                    found, cut = np.unique(target[order], return_index=True)
                    for t, mine in zip(found.tolist(), np.split(order, cut[1:]), strict=True):
                        e = np.cumsum(n[mine])
                        heads, bodies = segs.setdefault(t, ([], []))
                        heads.append(head[mine].tobytes())
                        bodies.append(chunk.buf[np.repeat(f[mine] - (e - n[mine]), n[mine]) + np.arange(e[-1])].tobytes())
                        size += int(e[-1])
                if size >= BUCKET_BYTES:
                    yield flush()
                    segs.clear()
                    size = 0
        if covers:
            yield from _by_bucket(np.full(sum(map(len, covers)), bucket), np.concatenate(covers), "cover")
        if segs:
            yield flush()

    return _beside_texts(asked, documents, buckets, run, DEALT)


def _bodies(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, bodies = [], []
    for b in map(_restored, blobs):
        n = int(np.frombuffer(b, "<i8", 1)[0])
        heads.append(np.frombuffer(b, HEAD, n, 8))
        bodies.append(np.frombuffer(b, np.uint8, -1, 8 + n * HEAD.itemsize))
    head = np.concatenate(heads)
    ends = np.cumsum(head["size"].astype(np.int64))
    return head, np.concatenate(bodies), ends - head["size"]


def _eights(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each of some positions, as one integer."""
    return np.lib.stride_tricks.as_strided(body, (max(0, len(body) - 7), 8), (1, 1))[at].view("<u8").ravel()


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Neighbouring segments of about ``SCAN`` bytes together."""
    ends, low = np.cumsum(size), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SCAN, side="right")))
        yield slice(low, high)
        low = high


def _gathered(body: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of segments one after the other, and where each begins there."""
    ends = np.cumsum(size)
    return body[np.repeat(at - (ends - size), size) + np.arange(ends[-1])], ends - size


def repeated_strings(head: np.ndarray, body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Covered runs of the segments (their number as ``doc``), group by group, from the suffix arrays of each group's joined segments."""
    if not len(head):
        return np.zeros(0, COVER)
    order = np.lexsort((head["doc"], head["group"]))
    head, at = head[order], at[order]
    new = np.concatenate([[True], head["group"][1:] != head["group"][:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = head["size"].astype(np.int64)
    before = np.cumsum(size + 1) - (size + 1)
    offset = before - before[first][group]  # of each segment in its text
    lengths = np.bincount(group, weights=size + 1).astype(np.int64)
    covers = []
    by_length = np.argsort(lengths, kind="stable")
    at_ = 0
    while at_ < len(by_length):
        # Texts of like length take their steps together, half a million symbols or so at a time.
        longest = lengths[by_length[at_]] * 3 // 2 + 8
        stop = min(int(np.searchsorted(lengths[by_length], longest, side="right")), at_ + max(1, 500_000 // longest))
        lanes = by_length[at_:stop]
        at_ = stop
        width = int(lengths[lanes].max())
        lane_of = np.full(len(first), -1)
        lane_of[lanes] = np.arange(len(lanes))
        mine = np.flatnonzero(lane_of[group] >= 0)
        n = size[mine]
        e = np.cumsum(n)
        source = np.repeat(at[mine] - (e - n), n) + np.arange(e[-1])
        target = np.repeat(lane_of[group[mine]] * width + offset[mine] - (e - n), n) + np.arange(e[-1])
        symbols = np.zeros(len(lanes) * width, np.int32)
        symbols[target] = body[source] + np.int32(2)
        stop_at = lane_of[group[mine]] * width + offset[mine] + n
        symbols[stop_at] = 1  # after each segment; after the last one the end of the text
        symbols[np.arange(len(lanes)) * width + lengths[lanes] - 1] = 0
        where = np.full(len(lanes) * width, -1, np.int64)
        where[target] = source
        segment = np.full(len(lanes) * width, -1, np.int64)
        segment[target] = np.repeat(mine, n)
        sa = suffix_arrays(symbols.reshape(len(lanes), width), lengths[lanes])
        flat = (np.arange(len(lanes))[:, None] * width + sa)[sa >= 0]
        s = segment[flat]
        p = where[flat]
        ok = (s >= 0) & (p + length <= at[s] + size[s])
        flat, s, p = flat[ok], s[ok], p[ok]  # suffix array order without what is shorter than a string
        lane = flat // width
        equal = lane[1:] == lane[:-1]
        for k in [*range(0, length - 7, 8), length - 8]:
            eights = _eights(body, p + k)
            equal &= eights[1:] == eights[:-1]
        begin = np.flatnonzero(np.concatenate([[True], ~equal])) if len(p) else np.zeros(0, np.int64)
        if not len(begin):
            continue
        earliest = np.repeat(np.minimum.reduceat(head["doc"][s], begin), np.diff(np.append(begin, len(p))))
        hit = head["doc"][s] > earliest
        c = np.zeros(int(hit.sum()), COVER)
        c["doc"], c["start"] = order[s[hit]], p[hit] - at[s[hit]]
        c["end"] = c["start"] + length
        covers.append(_merged(c))
    return _together(covers, COVER)


def cut_deeper(head: np.ndarray, body: np.ndarray, at: np.ndarray, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the segments' strings whose ``level`` smallest gram hashes agree, as segments of their own groups, and their places."""
    gram = min(GRAM, length)
    heads, places = [head[:0]], [at[:0]]
    for part in _slices(head["size"].astype(np.int64)):
        own, size = head[part], head["size"][part].astype(np.int64)
        near, begins = _gathered(body, at[part], size)
        times = size - length + 1
        owner = np.repeat(np.arange(len(own)), times)
        step = np.arange(len(owner)) - (np.cumsum(times) - times)[owner]
        string, grams = begins[owner] + step, np.arange(len(near) - gram + 1)
        windows = np.lib.stride_tricks.sliding_window_view(span_hash(prefix_hash(near), grams, grams + gram), length - gram + 1)
        key = np.concatenate([chain(list(np.sort(windows[string[low : low + 16_384]], axis=1)[:, :level].T)) for low in range(0, len(string), 16_384)])
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        out = own[owner[begin]].copy()
        out["group"] = chain([out["group"], key[begin]])
        out["start"] += step[begin].astype(np.uint32)
        out["size"] = np.diff(np.append(begin, len(owner))) + length - 1
        heads.append(out)
        places.append(at[part][owner[begin]] + step[begin])
    return np.concatenate(heads), np.concatenate(places)


def _content(head: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the segments' bytes."""
    out, size = np.empty(len(head), np.uint64), head["size"].astype(np.int64)
    for part in _slices(size):
        near, begins = _gathered(body, at[part], size[part])
        out[part] = span_hash(prefix_hash(near), begins, begins + size[part])
    return out


def compare_segments(head: np.ndarray, body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Covered runs of segments: copies collapse, groups are cut by ever more minima until they are small, and suffix arrays decide them all."""
    covers, heads, places, members, numbers = [], [], [], [], []
    known = 0
    levels = (1, 2, DEEP, 8, 16, length)
    for level in levels:
        if level > 1:
            head, at = cut_deeper(head, body, at, level, length)
        content = _content(head, body, at)
        order = np.lexsort((head["doc"], content, head["group"]))
        head, at, content = head[order], at[order], content[order]
        new_group = np.concatenate([[True], head["group"][1:] != head["group"][:-1]])
        new = new_group | np.concatenate([[True], content[1:] != content[:-1]])
        first, kind = np.flatnonzero(new), np.cumsum(new) - 1  # kind: number of the distinct segment
        later = head["doc"] > head["doc"][first][kind]
        covers.append(_covers(head[later], np.zeros(int(later.sum()), np.int64), head["size"][later]))
        of = np.bincount((np.cumsum(new_group) - 1)[first])[(np.cumsum(new_group) - 1)[first]]
        joined = (of > 1) & ((of <= JOINED) | (level == levels[-1]))
        number = np.full(len(first), -1)
        number[joined] = known + np.arange(int(joined.sum()))
        known += int(joined.sum())
        heads.append(head[first[joined]])
        places.append(at[first[joined]])
        member = np.flatnonzero(~later & (number[kind] >= 0))
        members.append(head[member])
        numbers.append(number[kind[member]])
        rest = ~later & (of > 1)[kind] & ~joined[kind]
        head, at = head[rest], at[rest]
        if not len(head):
            break
    found = repeated_strings(np.concatenate(heads), body, np.concatenate(places), length)
    # What holds for a segment holds for every place where its first document has it.
    member, number = np.concatenate(members), np.concatenate(numbers)
    order = np.argsort(number, kind="stable")
    member, number = member[order], number[order]
    low, high = (np.searchsorted(number, found["doc"], side) for side in ("left", "right"))
    n = high - low
    which = np.repeat(np.arange(len(found)), n)
    mine = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(which))
    covers.append(_covers(member[mine], found["start"][which].astype(np.int64), found["end"][which]))
    return _merged(np.concatenate(covers))


def _covers(head: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs from ``start`` to ``end`` of segments, in their texts."""
    c = np.empty(len(head), COVER)
    c["doc"], c["text"], c["start"], c["end"] = head["doc"], head["text"], head["start"] + start, head["start"] + end.astype(np.int64)
    return c


def _compared(answers: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [blob for _, _, blob in _by_blob(batches)]
        if blobs:
            parts = _bodies(blobs)
            blobs.clear()
            found = compare_segments(*parts, length)
            yield from _by_bucket(_doc_bucket(found["doc"], buckets), found, "cover")

    return answers.where("kind = 'segment'").repartitionById(buckets, F.col("bucket")).mapInArrow(run, DEALT)


def _cut(documents: DataFrame, covers: DataFrame, buckets: int, schema: str, emit: Callable[..., tuple[object, ...]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(blobs: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        cover, waiting = None, []

        def texts() -> Iterator[bytes]:
            for _, kind, blob in blobs:
                if kind == "cover":
                    waiting.append(_unpacked(blob, COVER))
                else:
                    yield blob

        for batch in _opened_texts(texts()):
            if cover is None:
                cover = _merged(_together(waiting, COVER))
                covered = np.ascontiguousarray(cover["doc"])
                waiting.clear()
            rows, ids = [], batch.column("doc_id")
            low, high = (np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(covered, ids.fill_null(0).to_numpy(), side), 0).tolist() for side in ("left", "right"))
            for doc, text, a, b in zip(ids.to_pylist(), batch.column("text").to_pylist(), low, high, strict=True):
                data, spans = (text or "").encode(), []
                if a < b:
                    own = cover[a:b]
                    own = own[own["text"] == zlib.crc32(data)]
                    spans = list(zip(own["start"].tolist(), own["end"].tolist(), strict=True))
                rows.append(emit(doc, data, spans))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return _beside_texts(covers, documents, buckets, run, schema)


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id. Null and empty texts lose nothing; null ids neither lose bytes nor count as earlier;
    rows of one id are one document to each other's texts; an empty table gives an empty result;
    columns besides ``doc_id`` and ``text`` are not read.
    """
    if length < 24:
        raise ValueError("strings shorter than 24 bytes have no anchors that tell them apart")
    documents = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    real = documents.where("doc_id is not null")
    rows, size = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Buckets follow the bytes; many tiny documents count too.
    buckets = 1 + (size + 64 * rows) // BUCKET_BYTES
    sample = materialise(real.sample(min(1.0, SAMPLE_DOCUMENTS / max(rows, 1)), seed=7), "repeat-sample")
    gram = min(GRAM, length)

    def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(chunk.buf) - gram + 1))
        row = np.repeat(np.arange(chunk.rows), chunk.ends - chunk.starts)[at]
        at, row = at[inside := at + gram <= chunk.ends[row]], row[inside]
        return row, span_hash(prefix_hash(chunk.buf), at, at + gram)

    common = _frequent(sample, grams)

    def segments(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, _, anchor, segment = runs(chunk, length, common)
        return row, _routed(anchor, segment, buckets)[-1]

    frequent = _frequent(sample, segments)
    asked = materialise(_requests(_meetings(real, length, buckets, common, frequent), buckets, frequent), "repeat-asked")
    least = _together([_unpacked(r[0], LEAST) for r in asked.where("kind = 'least'").select("data").collect()], LEAST)
    answers = materialise(_answers(asked.where("kind = 'asked'"), real, length, buckets, common, least), "repeat-answers")
    dropped(sample)
    dropped(asked)
    covers = answers.where("kind = 'cover'").unionByName(_compared(answers, buckets, length))

    def digest(doc: int | None, data: bytes, spans: list[tuple[int, int]]) -> tuple[object, ...]:
        return doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()

    return _cut(documents, covers, buckets, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
