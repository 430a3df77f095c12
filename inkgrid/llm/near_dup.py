"""Near duplicates by a chosen-path set similarity join over MinHash coordinates.

Documents with equal shingle sets are one class; only one of each class goes on. In each of
``TREES`` independent trees a node chooses one or two coordinates of the MinHash signature by a hash
of its path (1.25 on average, the inverse of the threshold) and branches its documents by their
values there. The depth follows the number of classes, so that nodes of unlike documents are small;
nodes that stay large are branched further. A node's documents are compared by 128-bit sketches;
pairs that could reach the threshold are confirmed on their full shingle sets.

A pair at the threshold reaches a common leaf of one tree with probability 0.58 at depth 4
(0.50 at depth 6), so ``TREES`` of 20 miss it with probability 3e-8 (1e-6).

In nodes dense with like documents only each document's first partner is confirmed that way. The
components of these links then show which documents are still apart; of the documents that dense
nodes tie together, those outside the largest component are compared with all the others in bounded
blocks, on their full sets, and only links leave a block. So no link that would join two components
is skipped, and a group of copies never expands into all of its pairs.

A node that takes more than ``LOCAL`` documents from one batch meets in parts: the batch's documents
in a task of their own, the first of them at the node. All its parts count as dense, or all branch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.components import components
from inkgrid.functions.tables import dropped
from inkgrid.llm.bytescan import LOWER, NON_SPACE, Chunk, chain, chunks, mix, prefix_hash, span_hash, words
from inkgrid.llm.shared import materialise, n_partitions, unused

THRESHOLD = 0.8
COORDINATES = 128
TREES = 20
#: Shingle overlap of unlike documents that the depth allows for, and the node size it aims at.
UNLIKE, SMALL = 0.06, 8
LARGE = 2000  # nodes above this branch further
LOCAL = 500  # documents of a batch of 4000 above which they meet apart from the rest of their node
#: Share of a large node that must be like its first document for the node to count as dense.
LIKE_FIRST = 0.95
#: A pair of Jaccard 0.8 agrees on 0.9 of 128 one-bit values; this bound is 4.5 standard deviations below.
SKETCH_BITS = 100
DEEPEST = 40  # levels after which large nodes branch no more
#: Class ids (8 bytes each) that may be broadcast as a filter; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Families (some 40 bytes each), and paths of nodes that branch, that may be broadcast.
MAX_BROADCAST_FAMILIES = 200_000

_RNG = np.random.default_rng(5)
FACTOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
FLIP = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct ``size``-word shingle, ordered by both; a shorter text is one shingle."""
    lowered = Chunk(chunk.first, chunk.rows, LOWER[chunk.buf], chunk.starts, chunk.ends)
    first, last, row = words(lowered, NON_SPACE)
    hashes = span_hash(prefix_hash(lowered.buf), first, last)
    n = len(row)
    keys = []
    count = np.bincount(row, minlength=chunk.rows)
    if n >= size:
        whole = row[size - 1 :] == row[: n - size + 1]
        h = chain([hashes[j : n - size + 1 + j] for j in range(size)])
        keys.append((row[: n - size + 1][whole].astype(np.uint64) << np.uint64(48)) | (h[whole] >> np.uint64(16)))
    begin = np.cumsum(count) - count
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            h = chain([hashes[begin[short] + j] for j in range(k)] + [np.full(len(short), k, np.uint64)])
            keys.append((short.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def signatures(row: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (n, COORDINATES) as 32 bits; rows without shingles are 0."""
    out = np.zeros((n, COORDINATES), np.uint32)
    if len(row):
        x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        present = row[starts]
        for i in range(COORDINATES):
            out[present, i] = np.minimum.reduceat((x ^ FLIP[i]) * FACTOR[i], starts)
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """One mixed bit of each coordinate, as two 64-bit words."""
    x = signature.copy()
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    bits = (x >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def branch(paths: np.ndarray, at: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of path nodes; ``at`` is the signature row of each. One child for each chosen coordinate."""
    first = (mix(paths ^ np.uint64(0x51)) >> np.uint64(7)) % np.uint64(COORDINATES)
    again = mix(paths ^ np.uint64(0x52))
    second = (again >> np.uint64(7)) % np.uint64(COORDINATES)
    two = np.flatnonzero(((again & np.uint64(3)) == 0) & (second != first))
    coordinate = np.concatenate([first, second[two]]).astype(np.int64)
    parent, at = np.concatenate([paths, paths[two]]), np.concatenate([at, at[two]])
    return chain([parent, coordinate.astype(np.uint64), signature[at, coordinate].astype(np.uint64)]), at


def describe(documents: DataFrame, size: int) -> DataFrame:
    """Written table of doc_id, n_shingles, digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                row, sets = shingle_sets(chunk, size)
                n = chunk.rows
                edge = np.searchsorted(row, np.arange(n + 1))
                digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                sig = signatures(row, sets, n)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(chunk.first, n), "n_shingles": pa.array(np.diff(edge), pa.int64()), "digest": pa.array(digest, pa.binary()), "signature": pa.array([s.tobytes() for s in sig], pa.binary())})

    return materialise(documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary"), "near-described")


NODES = "bucket int, nodes binary"
#: ``part`` is 0 at the node itself, else the batch whose documents meet apart; ``first`` marks the first of such a batch.
ROW = np.dtype([("path", "<u8"), ("part", "<u4"), ("first", "u1"), ("id", "<i8"), ("s0", "<u8"), ("s1", "<u8")])


def _in_parts(rows: np.ndarray, local: int) -> np.ndarray:
    """Rows of a batch, those of frequent paths as parts of their nodes, with their first rows at the node."""
    rows["part"], rows["first"] = 0, 0
    order = np.lexsort((rows["id"], rows["path"]))
    path = rows["path"][order]
    starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(path)))
    many = sizes > local
    if not many.any():
        return rows
    heads = rows[order[starts[many]]].copy()
    heads["first"] = 1
    apart = order[np.repeat(many, sizes)]
    # One number for the batch: its ids tell it from others.
    rows["part"][apart] = np.uint32(1) | np.bitwise_xor.reduce(mix(np.unique(rows["id"]).view(np.uint64))).astype(np.uint32)
    return np.concatenate([rows, heads])


def _dealt(rows: np.ndarray, buckets: int, local: int) -> Iterator[pa.RecordBatch]:
    """Rows in one blob a bucket of paths, so that the shuffle moves few large records."""
    rows = _in_parts(rows, local)
    bucket = (mix(rows["path"] + rows["part"]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    edge = [*at.tolist(), len(rows)]
    rows = rows[order]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "nodes": pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})


def _paths(classes: DataFrame, depth: int, trees: int, buckets: int, local: int) -> DataFrame:
    """All leaves at ``depth`` of every class, dealt by bucket; branching needs no other document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                n = part.num_rows
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(n, COORDINATES)
                at = np.repeat(np.arange(n), trees)
                paths = np.tile(mix(np.arange(1, trees + 1, dtype=np.uint64)), n)
                for _ in range(depth):
                    paths, at = branch(paths, at, signature)
                rows = np.empty(len(paths), ROW)
                sketch = sketches(signature)[at]
                rows["path"], rows["id"], rows["s0"], rows["s1"] = paths, part.column("class_id").to_numpy()[at], sketch[:, 0], sketch[:, 1]
                yield from _dealt(rows, buckets, local)

    return classes.select("class_id", "signature").mapInArrow(run, NODES)


def _deeper(rows: DataFrame, classes: DataFrame, buckets: int, local: int) -> DataFrame:
    """One more level below the nodes of ``rows`` (path, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(batch.num_rows, COORDINATES)
                paths, at = branch(batch.column("path").to_numpy().view(np.uint64), np.arange(batch.num_rows), signature)
                out = np.empty(len(paths), ROW)
                sketch = sketches(signature)[at]
                out["path"], out["id"], out["s0"], out["s1"] = paths, batch.column("a").to_numpy()[at], sketch[:, 0], sketch[:, 1]
                yield from _dealt(out, buckets, local)

    return rows.join(classes.select(F.col("class_id").alias("a"), "signature"), "a").mapInArrow(run, NODES)


def _alike(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(rows["s0"][i] ^ rows["s0"][j]).astype(np.int64) + np.bitwise_count(rows["s1"][i] ^ rows["s1"][j])
    return COORDINATES - differ >= SKETCH_BITS


FOUND = "kind string, path long, a long, b long"


def _found(kind: str, path: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(a), pa.string()), "path": pa.array(np.ascontiguousarray(path).view(np.int64)), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compare(nodes: DataFrame, last: bool, large: int) -> DataFrame:
    """Pairs of each node (kind ``pair``); rows of dense nodes (``dense``) and of nodes to branch further (``deeper``), with the node's first document.

    A large node that has branched often enough (``last``) counts as dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in batch.column("nodes").to_pylist()]
        if not held:
            return
        rows = np.frombuffer(b"".join(held), ROW)
        held.clear()
        rows = rows[np.lexsort((-rows["first"].astype(np.int8), rows["id"], rows["part"], rows["path"]))]
        other = (rows["path"][1:] != rows["path"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        fresh = np.concatenate([[True], other | (rows["id"][1:] != rows["id"][:-1])])
        rows = rows[fresh]
        starts = np.flatnonzero(np.concatenate([[True], (rows["path"][1:] != rows["path"][:-1]) | (rows["part"][1:] != rows["part"][:-1])]))
        sizes = np.diff(np.append(starts, len(rows)))
        #: Nodes that are met in parts, and the parts.
        parted = (np.maximum.reduceat(rows["first"], starts) > 0) | (rows["part"][starts] > 0)
        node = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(rows)) - starts[node]
        left_i, left_j = [], []
        # Small nodes: every pair, one distance after the other over all nodes at once.
        tiny = (sizes <= 64) & ~parted
        small = tiny[node]
        for k in range(1, int(sizes[tiny].max(initial=1))):
            j = np.flatnonzero(small & (place >= k))
            ok = _alike(rows, j - k, j)
            left_i.append(j[ok] - k)
            left_j.append(j[ok])
        for s, m, p in zip(starts[~tiny].tolist(), sizes[~tiny].tolist(), parted[~tiny].tolist(), strict=True):
            own = np.arange(s, s + m)
            if m > large or p:
                ok = _alike(rows, np.full(m - 1, s), own[1:])
                yield _found("pair", rows["path"][own[1:][ok]], np.full(ok.sum(), rows["id"][s]), rows["id"][own[1:][ok]])
                kind = "dense" if last or ok.mean() >= LIKE_FIRST else "deeper"
                yield _found(kind, rows["path"][own], rows["id"][own], np.full(m, rows["id"][s]))
                continue
            for a in range(s, s + m - 1):
                rest = np.arange(a + 1, s + m)
                ok = rest[_alike(rows, np.full(len(rest), a), rest)]
                left_i.append(np.full(len(ok), a))
                left_j.append(ok)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left_i, left_j))
        # Dense nodes have more than four pairs a document: of those only each document's first partner for now.
        pairs = np.bincount(node[i], minlength=len(starts))
        dense = pairs > 4 * sizes
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        first = np.concatenate([[True], j[1:] != j[:-1]]) if len(j) else np.zeros(0, bool)
        use = first | ~dense[node[i]]
        yield _found("pair", rows["path"][i[use]], rows["id"][i[use]], rows["id"][j[use]])
        waits = dense[node]
        yield _found("dense", rows["path"][waits], rows["id"][waits], rows["id"][starts[node]][waits])

    return nodes.repartition(n_partitions(nodes.sparkSession), "bucket").mapInArrow(run, FOUND)


FAMILY_BLOCK = 512
#: Equal coordinates of 128 that a pair at the threshold falls short of with probability 1e-5.
LEAST_EQUAL = 83


def _block_links(left: np.ndarray, right: np.ndarray, signature: np.ndarray, comp: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links across components between two lists of rows, confirmed on the full sets."""
    out = []
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        equal = np.zeros((len(part), len(right)), np.int16)
        for c in range(COORDINATES):
            equal += signature[part, c][:, None] == signature[right, c][None, :]
        i, j = np.nonzero((equal >= LEAST_EQUAL) & (comp[part][:, None] != comp[right][None, :]))
        if not len(i):
            continue
        # Shared shingles of all these pairs at once: a 0/1 matrix of the rows by their shingles.
        rows = np.unique(np.concatenate([part[i], right[j]]))
        unpacked = [_unpacked(sets[r]) for r in rows.tolist()]
        size = np.array([len(u) for u in unpacked])
        _, column = np.unique(np.concatenate(unpacked), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size)
        a, b = np.searchsorted(rows, part[i]), np.searchsorted(rows, right[j])
        shared = np.zeros(len(i), np.int64)
        mine = np.unique(a)
        where = np.zeros(len(rows), np.int64)
        where[mine] = np.arange(len(mine))
        for low in range(0, int(column.max()) + 1, 16_384):
            inside = (column >= low) & (column < low + 16_384)
            matrix = np.zeros((len(rows), 16_384), np.float32)
            matrix[row[inside], column[inside] - low] = 1
            shared += (matrix[mine] @ matrix.T)[where[a], b].astype(np.int64)
        ok = 100 * shared >= percent * (size[a] + size[b] - shared)
        out += list(zip(part[i[ok]].tolist(), right[j[ok]].tolist(), strict=True))
    return out


def _family_links(waiting: DataFrame, parts: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Links across components among documents that dense nodes tie together, exactly.

    A family is what common dense nodes connect. Links inside its largest component change nothing,
    so its documents outside that one, in blocks of about ``FAMILY_BLOCK``, are compared with all its
    documents, in such blocks too; each pair of blocks is one bounded group, and only links leave it.
    """
    family = components(waiting.where("a <> b")).withColumnsRenamed({"node": "a", "component": "family"})
    family = materialise(family.join(parts.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")), "near-families")
    counts = family.groupBy("family", "component").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("family").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    sizes = materialise(sizes.where("parts > 1").select("family", "main", F.ceil((F.col("n") - F.col("most")) / FAMILY_BLOCK).cast("int").alias("lows"), F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("highs")), "near-sizes")
    if sizes.count() <= MAX_BROADCAST_FAMILIES:
        sizes = F.broadcast(sizes)
    full = family.join(sizes, "family").join(classes.select(F.col("class_id").alias("a"), "signature"), "a").join(sets.withColumnRenamed("id", "a"), "a")
    block = lambda of: F.pmod(F.xxhash64("a"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    outside = full.where("component <> main").withColumn("low", block("lows")).withColumn("high", every("highs")).withColumn("outside", F.lit(True))
    whole = full.withColumn("low", every("lows")).withColumn("high", block("highs")).withColumn("outside", F.lit(False))
    rows = outside.unionByName(whole).select("family", "low", "high", "outside", "a", "component", "signature", "shingles")
    percent = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table["a"].to_numpy(), table["component"].to_numpy()
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u4").reshape(len(ids), COORDINATES)
        one = table["outside"].to_numpy()
        found = _block_links(np.flatnonzero(one), np.flatnonzero(~one), signature, comp, table["shingles"].to_pylist(), percent)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return materialise(rows.groupBy("family", "low", "high").applyInArrow(run, "a long, b long"), "near-links")


def _sets(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Written table of the full shingle sets of the documents in ``ids`` (id)."""
    wanted = np.sort(np.array([r[0] for r in ids.collect()], np.int64)) if ids.count() <= MAX_BROADCAST_IDS else None
    documents = documents.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null")
    if wanted is None:
        documents = documents.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(), wanted)))
            for chunk in chunks(batch.column("text")):
                row, sets = shingle_sets(chunk, size)
                edge = np.searchsorted(row, np.arange(chunk.rows + 1))
                # 48 bits each: the upper 32 and then the lower 16.
                blobs = [(sets[a:b] >> np.uint64(16)).astype("<u4").tobytes() + (sets[a:b] & np.uint64(0xFFFF)).astype("<u2").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").slice(chunk.first, chunk.rows), "shingles": pa.array(blobs, pa.binary())})

    return materialise(documents.mapInArrow(run, "id long, shingles binary"), "near-sets")


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return (np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(blob, "<u2", n, 4 * n)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold, exactly: 100 * intersection >= 100 * threshold * union."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                n, m = len(x) // 6, len(y) // 6
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([_unpacked(x), _unpacked(y)]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (n + m - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "near-links")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, threshold: float = THRESHOLD, trees: int = TREES, large: int = LARGE, local: int = LOCAL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id), kept.

    Documents without words, and null ids, link with nothing; a null id has a null component and is
    kept. Repeated ids count as one document. An empty table gives an empty result. Columns besides
    ``doc_id`` and ``text`` are not read.
    """
    spark = documents.sparkSession
    described = describe(documents, shingle)
    real = described.where("doc_id is not null and n_shingles > 0")
    classes = materialise(real.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("signature").alias("signature")), "near-classes")
    count = classes.count()
    depth = max(1, math.ceil(math.log(max(count, 2) / SMALL) / -math.log(UNLIKE))) if count > SMALL else 1
    buckets = 4 * n_partitions(spark)
    found = materialise(_compare(_paths(classes, depth, trees, buckets, local), False, large), "near-found")
    pairs, dense, compared = [], [], [found]
    for step in range(1, DEEPEST + 1):
        pairs.append(found.where("kind = 'pair'"))
        deeper, settled = found.where("kind = 'deeper'").select("path", "a"), found.where("kind = 'dense'").select("path", "a", "b")
        if deeper.isEmpty():
            dense.append(settled)
            break
        # Parts of one node go the same way.
        paths = materialise(deeper.select("path").distinct(), "near-paths")
        if paths.count() <= MAX_BROADCAST_FAMILIES:
            paths = F.broadcast(paths)
        dense.append(settled.join(paths, "path", "left_anti"))
        deeper = deeper.unionByName(settled.join(paths, "path", "left_semi").select("path", "a")).distinct()
        found = materialise(_compare(_deeper(deeper, classes, buckets, local), step >= DEEPEST - 1, large), "near-found")
        compared.append(found)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    tried = materialise(_distinct_pairs(union(pairs)), "near-pairs")
    waiting = materialise(union(dense).select("a", "b").distinct(), "near-dense")
    for table in compared:
        dropped(table)
    ids = materialise(tried.select(F.col("a").alias("id")).union(tried.select("b")).union(waiting.select("a")).distinct(), "near-ids")
    sets = _sets(documents, ids, shingle)
    links = [_confirmed(tried, sets, threshold)]
    parts = materialise(components(links[0]), "near-components")
    if not waiting.isEmpty():
        links.append(_family_links(waiting, parts, sets, classes, threshold))
        parts = materialise(components(union(links)), "near-components")
    dropped(sets)
    named = classes.select("digest", "class_id").join(parts, F.col("class_id") == F.col("node"), "left").select("digest", F.coalesce("component", "class_id").alias("component_id"))
    linked = described.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    rest = described.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of near copies, that of the smallest id, with all its columns.

    Rows that repeat id and text stay once (the one with the smallest hash of all its columns). Rows of
    one id with different texts are documents of their own: each stays or goes by its own text. A null id
    always stays. Empty tables stay empty.
    """
    columns = documents.columns
    row, place = unused(columns, "row"), unused(columns, "place")
    digest = F.coalesce(F.md5("text"), F.lit(""))
    real = documents.where("doc_id is not null")
    several = materialise(real.select("doc_id", digest.alias("d")).groupBy("doc_id").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select("doc_id"), "near-several")
    if several.isEmpty():
        kept = near_duplicates(documents, shingle, threshold).where("kept and doc_id is not null").select("doc_id").distinct()
        real = real.join(kept, "doc_id", "left_semi")
    else:
        # Such ids become one for each text; of a component the row of the smallest given id stays.
        if several.count() <= MAX_BROADCAST_IDS:
            several = F.broadcast(several)
        own = several.withColumn(place, F.lit(True))
        real = real.join(own, "doc_id", "left").withColumn(row, F.when(F.col(place), F.xxhash64("doc_id", digest)).otherwise(F.col("doc_id").cast("long"))).drop(place)
        ids = real.select(F.col(row).alias("r"), F.col("doc_id").alias("d")).distinct()
        found = near_duplicates(real.select(F.col(row).alias("doc_id"), "text"), shingle, threshold).select("doc_id", "component_id").distinct()
        first = found.join(ids, F.col("doc_id") == F.col("r")).groupBy("component_id").agg(F.min(F.struct("d", "r")).alias("m"))
        real = real.join(first.select(F.col("m.r").alias(row)), row, "left_semi")
    same = Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*columns))
    once = real.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*columns)
    return once.unionByName(documents.where("doc_id is null"))
