"""Hashed text features, and the bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.tables import dropped
from inkgrid.llm.bytescan import ALNUM, LOWER, MULTIPLIER, NON_SPACE, Chunk, chain, chunks, keyed, mix, prefix_hash, span_hash, words
from inkgrid.llm.shared import materialise

#: Rows, hashed buckets, in ascending order by row.
Hashed = tuple[np.ndarray, np.ndarray]


def word_and_char_grams(chunk: Chunk, bits: int) -> list[Hashed]:
    """Occurrences of words, word pairs and grams of 4 characters (code points), each hashed into its own table."""
    first, last, row = words(chunk, NON_SPACE)
    out: list[Hashed] = []
    shift = np.uint64(64 - bits)
    hashes = span_hash(prefix_hash(chunk.buf), first, last)
    out.append((row, (hashes >> shift).astype(np.int64)))
    same = row[1:] == row[:-1]
    out.append((row[1:][same], (chain([hashes[:-1][same], hashes[1:][same]]) >> shift).astype(np.int64)))
    points = np.frombuffer(chunk.buf.tobytes().decode().encode("utf-32-le"), "<u4")
    n = max(0, len(points) - 3)
    gram = points[:n].copy()
    for i in range(1, 4):
        gram *= np.uint32(0x9E3779B1)
        gram ^= points[i : n + i]
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    before = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
    starts = before[chunk.starts]
    lengths = np.maximum(before[chunk.ends] - starts - 3, 0)
    inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    out.append((np.repeat(np.arange(chunk.rows), lengths), (gram[inside] >> np.uint32(32 - bits)).astype(np.int64)))
    return out


#: Code points of a stem, and how many words of one stem a text's terms tell apart.
STEM, TELL = 5, 4


def distinct_terms(chunk: Chunk, bits: int) -> Hashed:
    """Distinct lower-cased alphanumeric words of each text as hashed buckets; and for its words longer than ``STEM`` characters, that a first, a second, ... distinct word has their stem."""
    lowered = Chunk(chunk.first, chunk.rows, LOWER[chunk.buf], chunk.starts, chunk.ends)
    first, last, row = words(lowered, ALNUM)
    prefix = prefix_hash(lowered.buf)
    key, at = np.unique(keyed(row, span_hash(prefix, first, last)), return_index=True)
    first, last, row = first[at], last[at], row[at]
    points = np.flatnonzero((lowered.buf & 0xC0) != 0x80)
    number = np.searchsorted(points, first) + STEM
    inside = np.flatnonzero(number < len(points))
    stop = points[number[inside]]
    inside, stop = inside[stop < last[inside]], stop[stop < last[inside]]
    stems = keyed(row[inside], span_hash(prefix, first[inside], stop))
    stems.sort()
    begin = np.flatnonzero(np.concatenate([[True], stems[1:] != stems[:-1]])) if len(stems) else np.zeros(0, np.int64)
    count = np.minimum(np.diff(np.append(begin, len(stems))), TELL)
    of = np.repeat(stems[begin], count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 1
    told = keyed((of >> np.uint64(48)).astype(np.int64), mix((of << np.uint64(16)) + place.astype(np.uint64)))
    key = np.unique(np.concatenate([key, told]) >> np.uint64(48 - bits))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def sums_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def bounded_labels(labels: DataFrame, target: str, rows: int, keep: Column | None = None) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id, with one 0/1 label each.

    Null ids and labels are dropped; an id with several labels takes the largest. The bound is
    what makes the broadcast join and the driver-side fit safe at any size of the table.
    """
    found = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
    if keep is not None:
        found = found.where(keep)
    found = found.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


#: Bytes of features that a fit takes to the driver.
MAX_FEATURE_BYTES = 192 << 20


def labelled_features(documents: DataFrame, chosen: DataFrame, featurise: Callable[[Chunk], list[Hashed]], most: int = MAX_FEATURE_BYTES) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Labels, and buckets with their counts, of the chosen documents, on the driver, by id: as many rows as ``chosen`` is bounded to.

    If their features exceed ``most`` bytes, which takes very long texts, the rows whose hash of the id comes first
    take part, as many as fit; so the sample is bounded by rows and by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                blobs: list[list[bytes]] = []
                for rows, buckets in featurise(chunk):
                    at = np.searchsorted(rows, np.arange(chunk.rows + 1))
                    counted = [np.unique(buckets[at[i] : at[i + 1]], return_counts=True) for i in range(chunk.rows)]
                    blobs.append([np.concatenate(x).astype("<u4").tobytes() for x in counted])
                part = slice(chunk.first, chunk.first + chunk.rows)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[part], pa.int64()), "label": pa.array(label[part], pa.int32()), "features": pa.array([list(x) for x in zip(*blobs, strict=True)], pa.list_(pa.binary()))})

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features array<binary>")
    # A repeated id counts once, by its longest features.
    rows = materialise(rows.withColumn("size", F.expr("aggregate(features, 0L, (s, x) -> s + octet_length(x))")), "features")
    sizes = rows.groupBy("doc_id").agg(F.max("size").alias("size"))
    # One row an id, as many as ``chosen`` is bounded to: a window in one task.
    fits = sizes.withColumn("sum", F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("sum") <= most)
    found = rows.join(F.broadcast(fits.select("doc_id", "size")), ["doc_id", "size"]).select("doc_id", "label", "features").toArrow()
    dropped(rows)
    ids, label = found["doc_id"].to_numpy(), found["label"].to_numpy()
    _, first = np.unique(ids, return_index=True)
    chunk_of = np.cumsum([0, *(len(c) for c in found["features"].chunks)])
    out = []
    for i in first.tolist():
        at = int(np.searchsorted(chunk_of, i, side="right")) - 1
        parts = [np.frombuffer(b.as_buffer(), "<u4") for b in found["features"].chunk(at)[i - int(chunk_of[at])]]
        out.append((int(label[i]), [(x[: len(x) // 2], x[len(x) // 2 :]) for x in parts]))
    return out


def stacked(rows: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets (tables side by side, ``width`` apart) and shares of the row's occurrences, without buckets that only one row has."""
    doc = np.concatenate([np.full(len(x[0]), i, np.int32) for i, (_, tables) in enumerate(rows) for x in tables])
    bucket = np.concatenate([x[0].astype(np.int32) + t * width for _, tables in rows for t, x in enumerate(tables)])
    value = np.concatenate([(x[1] / max(1, int(x[1].sum()))).astype(np.float32) for _, tables in rows for x in tables])
    shared = np.bincount(bucket)[bucket] > 1
    return doc[shared], bucket[shared], value[shared]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def unit_hash(values: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from integers, the same on every machine."""
    return (mix(values.astype(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
