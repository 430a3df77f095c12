"""Concatenate and cut: token ids of all documents in one sequence, cut into windows of a fixed size.

Pass one tokenizes each document where it lies and writes its ids with their offset in the
partition. The partitions' totals give every partition's global offset by a prefix sum. Pass two
cuts at the multiples of the window; only totals are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.shared import materialise
from inkgrid.llm.tokens import default_tokenizer, encoded

WINDOW = 1024
#: Partitions whose offsets may be broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_PARTS = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize_partitions(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Written table: part, local (tokens before the document in its partition), doc_id, ids (4-byte or 2-byte, by ``width``)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        for docs, tokens in encoded(batches, path):
            lengths = np.array([len(t) for t in tokens])
            starts = local + np.cumsum(lengths) - lengths
            local += int(lengths.sum())
            n = len(docs)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "width": pa.array([tokens[0].itemsize] * n, pa.int32()), "ids": pa.array([t.tobytes() for t in tokens], pa.binary())})

    table = documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "part int, local long, n_tokens long, doc_id long, width int, ids binary")
    return materialise(table, "packing")


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document, in windows of ``window`` tokens that only the last one may not fill.

    Null texts are empty documents of one end id; repeated rows are packed each; an empty table
    gives no piece; columns besides ``doc_id`` and ``text`` are not read.
    """
    tokens = tokenize_partitions(documents, tokenizer)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    if totals.count() <= MAX_BROADCAST_PARTS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int | None]] = {c.split()[0]: [] for c in PIECES.split(", ")}
            for doc, first, width, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "width", "ids")), strict=True):
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                cuts = [0, *range(window - first % window, len(ids), window), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out["doc_id"].append(doc)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b]))
                    out["doc_tokens"].append(len(ids))
                    out["sequence_id"].append((first + a) // window)
                    out["offset"].append((first + a) % window)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("first"), "width", "ids")
    return placed.mapInArrow(run, PIECES)
