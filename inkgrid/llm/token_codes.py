"""Token ids as directly addressable codes, in files of which any token can be read without decoding the rest.

Files are rows of a Parquet table whose codes are stored as they are, neither compressed nor encoded
again, some ten thousand tokens a file, so that a token costs reading one such value.

A code holds the lowest ``CHUNK_BITS`` bits of every id in level 0, the next bits of the ids that
need them in level 1, and so on. A bitmap beside each level marks the ids that continue; a rank
directory has the number of marks before each block of 512, so token ``i`` takes one byte and one
rank a level. Layout, little-endian: ``DAC1``, levels (u4), then by level: entries (u8), chunk bytes,
bitmap bytes, directory (u4 a block).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.shared import materialise, n_partitions
from inkgrid.llm.tokens import default_tokenizer, encoded

MAGIC = b"DAC1"
CHUNK_BITS = 8
BLOCK = 512
SHARD_TOKENS = 1 << 16
#: Bytes of a row group of token files: some dozens of files, each group with its own bounds of (part, number).
ROW_GROUP = 4 << 20


def encode_codes(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint64), []
    while True:
        goes_on = rest >= 1 << CHUNK_BITS
        marks = np.packbits(goes_on, bitorder="little")
        padded = np.concatenate([goes_on, np.zeros(-len(rest) % BLOCK, bool)]).reshape(-1, BLOCK)
        ranks = np.concatenate([[0], np.cumsum(padded.sum(1))])[:-1].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes() + marks.tobytes() + ranks.tobytes())
        if not goes_on.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[goes_on] >> np.uint64(CHUNK_BITS)


@dataclass
class Codes:
    """A view of an encoded file."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def open(cls, data: bytes) -> Codes:
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (count,), at, levels = struct.unpack_from("<I", data, 4), 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, size in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", -(-n // BLOCK))):
                parts.append(np.frombuffer(data, kind, size, at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token ``i``, by one byte and one rank a level."""
        value = 0
        for depth, (chunk, marks, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK_BITS * depth)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(marks[block * BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out = None
        for chunk, marks, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(marks, count=len(chunk), bitorder="little").astype(bool)] += out << np.uint32(CHUNK_BITS)
            out = value
        return out


FILES = "part int, number int, n_tokens long, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, codes binary"
#: Files that a filter names; beyond, the join alone finds them.
MAX_NAMED = 256


def write_token_files(documents: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the token files of all documents in ascending ``doc_id`` order; returns the table of files.

    Texts are dealt by ranges of ``doc_id`` and tokenized once, behind that shuffle. Each file holds
    whole documents, about ``shard_tokens`` tokens of them, and is one row of a Parquet table in the
    shared folder: (part, number) orders the files. Null texts count as empty, null ids come first,
    repeated rows stay apart; an empty table gives no file; columns besides ``doc_id`` and ``text`` are
    not read. Rows are dealt by ranges of ``doc_id`` and text hash, so that many rows of one id, or of
    none, do not meet in one task.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_tokens": pa.array([size], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "doc_starts": pa.array([[0, *np.cumsum(lengths)[:-1].tolist()]], pa.list_(pa.int64())), "doc_tokens": pa.array([lengths], pa.list_(pa.int64())), "codes": pa.array([encode_codes(np.concatenate(held))], pa.binary())})

        for docs, tokens in encoded(batches, path):
            for doc, token in zip(docs, tokens, strict=True):
                ids.append(doc)
                held.append(token)
                size += len(token)
                if size >= shard_tokens:
                    yield file()
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield file()

    ordered = documents.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) as salt").repartitionByRange(n_partitions(documents.sparkSession), "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return materialise(ordered.select("doc_id", "text").mapInArrow(run, FILES), "token-files", compression="none", **{"parquet.enable.dictionary": "false", "parquet.block.size": str(ROW_GROUP)})


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of the token files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    The starts are prefix sums over parts and over the files of each; the tokens themselves never leave
    their file's task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, ids, starts, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "doc_ids", "doc_starts", "doc_tokens", "codes")), strict=True):
                tokens = Codes.open(data).all().astype("<u4")
                crc = [zlib.crc32(tokens[a : a + n]) for a, n in zip(starts, lengths, strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "number": pa.array([number] * n, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = files.mapInArrow(run, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Totals of parts, one row a partition, go through one task; files only through that of their part.
    earlier = lambda window: F.coalesce(F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", earlier(Window.orderBy("part")).alias("start"))
    within = files.select("part", "number", earlier(Window.partitionBy("part").orderBy("number")).alias("within"))
    bases = within.join(parts, "part").select("part", "number", (F.col("start") + F.col("within")).alias("base"))
    return docs.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Single tokens by random access: ``wanted`` has doc_id and position (tokens of the document before it); adds token_id.

    Only the asked entries of a file's levels are touched, one byte and one rank each. Which files are asked is
    found from their lists of documents, without their codes. Up to ``MAX_NAMED`` such files are then named to the scan, which
    passes over the pages of all others (their statistics rule them out); more are joined. Positions beyond
    the document's end, and unknown or null ids, give no row; of rows that repeat an id each answers.
    """
    spots = files.select("part", "number", F.inline(F.arrays_zip("doc_ids", "doc_starts", "doc_tokens"))).withColumnRenamed("doc_ids", "doc_id")
    asked = wanted.select("doc_id", "position").join(spots, "doc_id").where("position >= 0 and position < doc_tokens")
    asked = materialise(asked.select("part", "number", "doc_id", "position", (F.col("doc_starts") + F.col("position")).alias("at")), "token-places")
    named = asked.select("part", "number").distinct().limit(MAX_NAMED + 1).collect()
    asked = asked.groupBy("part", "number").agg(F.collect_list(F.struct("doc_id", "position", "at")).alias("asked"))
    few = files.select("part", "number", "codes")
    if len(named) <= MAX_NAMED:
        here = [(F.col("part") == r["part"]) & (F.col("number") == r["number"]) for r in named]
        few = few.where(reduce(or_, here, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(batch.column("codes").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                codes = Codes.open(data)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([a["doc_id"] for a in asked], pa.int64()), "position": pa.array([a["position"] for a in asked], pa.int64()), "token_id": pa.array([codes[a["at"]] for a in asked], pa.int64())})

    return few.join(asked, ["part", "number"]).select("codes", "asked").mapInArrow(run, "doc_id long, position long, token_id long")
