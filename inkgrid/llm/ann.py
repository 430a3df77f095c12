"""Largest inner products by score-aware anisotropic quantisation.

Vectors are coded four bits a pair of dimensions. Codebooks and codes minimise the anisotropic loss
``|r|^2 + (eta - 1) <r, x>^2 / |x|^2`` of the residual ``r``: an error along the vector changes large
inner products, one across it hardly does. A query scores all codes by table look-ups, two codes a
byte. The best are ranked again by exact products. Every row whose score plus the most that
its residual can add (``|q| |r|``) reaches the last of them is scored once more with a second level of
four-bit codes, of the residual itself, and those that still reach it with what is left of the residual are
ranked exactly too: no row is cut by its code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.shared import materialise

#: Rows and components of the sample that the codebooks are fitted on.
SAMPLE, SAMPLE_VALUES = 20_000, 8_000_000
THRESHOLD = 0.2  # share of the norm from which a product counts as large; sets eta
RERANK = 100
NEAREST = 20
BLOCK = 16_384
QUERY_BLOCK = 256


@dataclass
class Quantiser:
    centres: np.ndarray  # (pairs of dimensions, 16, 2)
    eta: float
    second: np.ndarray | None = None  # of residuals, alike

    @property
    def dims(self) -> int:
        return 2 * len(self.centres)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float64), ((0, 0), (0, self.dims - x.shape[1]))).reshape(len(x), -1, 2)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, pairs) by coordinate descent on the anisotropic loss."""
        x = self.pad(x)
        n, pairs, _ = x.shape
        norm = np.maximum((x * x).sum((1, 2)), 1e-300)
        code = np.zeros((n, pairs), np.uint8)
        inner = np.zeros((n, pairs))  # <r, x> by pair
        for sweep in range(sweeps + 1):
            for m in range(pairs):
                r = x[:, m, None, :] - self.centres[m][None]
                square, along = (r * r).sum(2), (r * x[:, m, None, :]).sum(2)
                rest = inner.sum(1) - inner[:, m] if sweep else np.zeros(n)
                cost = square + (self.eta - 1) * (rest[:, None] + along) ** 2 / norm[:, None] * (sweep > 0)
                best = cost.argmin(1)
                code[:, m], inner[:, m] = best, along[np.arange(n), best]
        return code

    def residuals(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.pad(x) - np.stack([self.centres[m][code[:, m]] for m in range(len(self.centres))], 1)

    def reaches(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second codes, and by how much, for a query of length 1, an exact product can exceed the score of the first and of both, float32 sums included."""
        away, length = self.residuals(x, code), np.sqrt((x.astype(np.float64) ** 2).sum(1))
        second = np.stack([((away[:, m, None] - self.second[m][None]) ** 2).sum(2).argmin(1) for m in range(len(self.second))], 1).astype(np.uint8)
        left = away - np.stack([self.second[m][second[:, m]] for m in range(len(self.second))], 1)
        one, two = (np.sqrt((r * r).sum((1, 2))) for r in (away, left))
        rounding = np.finfo(np.float32).eps * (2 * len(self.centres) + 8) * (one + two + length)
        return second, one + rounding, two + rounding

    def tables(self, queries: np.ndarray, second: bool = False) -> np.ndarray:
        """Scores of every byte of two codes, by query and byte position: (queries, bytes, 256)."""
        q = self.pad(queries)
        single = np.einsum("qmd,mcd->qmc", q, self.second if second else self.centres)
        if single.shape[1] % 2:
            single = np.pad(single, ((0, 0), (0, 1), (0, 0)))
        low, high = single[:, 0::2], single[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def pack_nibbles(code: np.ndarray) -> np.ndarray:
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, 0::2] | (code[:, 1::2] << 4)


def fit(sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = 6) -> Quantiser:
    """Codebooks from a bounded sample: k-means starts, then codes and weighted centres by turns."""
    d = sample.shape[1] + sample.shape[1] % 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(11)
    first = sample[rng.choice(len(sample), 16, replace=len(sample) < 16)]
    q = Quantiser(np.zeros((d // 2, 16, 2)), eta)
    q.centres = q.pad(first).transpose(1, 0, 2).copy()
    x = q.pad(sample)
    norm = np.maximum((x * x).sum((1, 2)), 1e-300)
    for step in range(rounds):
        code = q.codes(sample, sweeps=1 if step else 0)
        picked = np.stack([q.centres[m][code[:, m]] for m in range(d // 2)], 1)
        inner = ((x - picked) * x).sum(2)
        for m in range(d // 2):
            rest = (inner.sum(1) - inner[:, m]) * (step > 0)
            g = (eta - 1) * (step > 0) / norm
            xm = x[:, m]
            outer = xm[:, :, None] * xm[:, None, :] * g[:, None, None]
            right = xm + (g * (rest + (xm * xm).sum(1)))[:, None] * xm
            for c in range(16):
                mine = code[:, m] == c
                if mine.any():
                    q.centres[m, c] = np.linalg.solve(np.eye(2) * mine.sum() + outer[mine].sum(0), right[mine].sum(0))
                else:
                    q.centres[m, c] = xm[rng.integers(len(xm))]
    q.second = _second(q.residuals(sample, q.codes(sample)), rng)
    return q


def _second(residuals: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of residuals, pair by pair, by k-means."""
    centres = residuals[rng.choice(len(residuals), 16, replace=len(residuals) < 16)].transpose(1, 0, 2).copy()
    for own, r in zip(centres, residuals.transpose(1, 0, 2), strict=True):
        for _ in range(rounds):
            code = ((r[:, None] - own[None]) ** 2).sum(2).argmin(1)
            n = np.bincount(code, minlength=16)
            sums = np.stack([np.bincount(code, weights=r[:, d], minlength=16) for d in range(2)], 1)
            own[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Coded:
    """A block of rows with both levels of codes, a line for each byte."""

    quantiser: Quantiser
    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    second: np.ndarray
    reach_first: np.ndarray
    reach_second: np.ndarray

    def nearest(self, asking: int, q: np.ndarray, nearest: int, rerank: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact products of the nearest rows, nearest first, and how many rows were ranked exactly."""
        table = self.quantiser.tables(q[None])[0]
        score = table[0][self.first[0]]
        for t, codes in zip(table[1:], self.first[1:], strict=True):
            score += t[codes]
        score[self.ids == asking] = -np.inf
        found = best(score, rerank)
        found = found[self.ids[found] != asking]
        exact = exact_products(q, self.vectors[found].astype(np.float64))
        if len(exact) >= nearest:
            last, length = np.partition(exact, len(exact) - nearest)[len(exact) - nearest], np.sqrt((q**2).sum())
            may = score + length * self.reach_first >= last
            may[found] = False
            more = np.flatnonzero(may)
            table = self.quantiser.tables(q[None], second=True)[0]
            finer = score[more]
            for t, codes in zip(table, self.second, strict=True):
                finer += t[codes[more]]
            more = more[finer + length * self.reach_second[more] >= last]
        else:
            more = np.setdiff1d(np.flatnonzero(self.ids != asking), found)
        found, exact = np.concatenate([found, more]), np.concatenate([exact, exact_products(q, self.vectors[more].astype(np.float64))])
        top = np.lexsort((self.ids[found], -exact))[:nearest]
        return self.ids[found[top]], exact[top], len(found)


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Double-precision inner products, summed dimension by dimension."""
    total = np.zeros(len(vectors))
    for d in range(len(query)):
        total += query[d] * vectors[:, d]
    return total


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores; among equals the first places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, equal = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
    return np.sort(np.concatenate([above, equal[: k - len(above)]]))


def usable(vector: str) -> Column:
    """Vectors that take part: no null, no component that is null or not finite, not all zero."""
    x = F.col(vector)
    return x.isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """For each query row its nearest rows by inner product: query_id, rank, vec_id, score.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read. Null ids, unusable
    vectors and vectors of another length than the commonest take no part. Rows that share the
    query's id are not its candidates; other repeated rows count each. Ties go to the smaller id.
    The codebooks are fitted on at most ``sample`` rows and ``SAMPLE_VALUES`` components; every row is coded and searched. Queries
    and codes meet block by block, and each block passes on its ``nearest`` rows a query; they are the
    exact ones, however many rows share a code.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("query")).where(F.col("vec_id").isNotNull() & usable("vector"))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == lengths["n"])
    width = lengths["n"]
    picked = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(sample, SAMPLE_VALUES // width))).toArrow()
    quantiser = fit(picked["vector"].combine_chunks().flatten().to_numpy().reshape(-1, width))

    def blocks(size: int, coded: bool):  # noqa: ANN202
        def emit(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(order), size):
                part = order[at : at + size]
                data = {"ids": pa.array([ids[part].tobytes()], pa.binary()), "vectors": pa.array([x[part].tobytes()], pa.binary())}
                if coded:
                    code = quantiser.codes(x[part])
                    second, *reach = quantiser.reaches(x[part], code)
                    lines = [np.ascontiguousarray(pack_nibbles(c).T).tobytes() for c in (code, second)]
                    data |= {n: pa.array([v], pa.binary()) for n, v in zip(("first", "second", "reach"), (*lines, np.stack(reach).tobytes()), strict=True)}
                yield pa.RecordBatch.from_pydict(data)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(_rows(batch))
                    n += batch.num_rows
                if n >= size:
                    yield from emit(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, n = [], 0
            if held:
                yield from emit(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        return run

    kind = np.float64 if "double" in dict(rows.dtypes)["vector"] else np.float32
    if dict(rows.dtypes)["vector"] not in ("array<double>", "array<float>"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
        kind = np.float64
    coded = materialise(rows.select("vec_id", "vector").mapInArrow(blocks(BLOCK, True), "ids binary, vectors binary, first binary, second binary, reach binary"), "ann-codes")
    asked = materialise(rows.where("query").select("vec_id", "vector").mapInArrow(blocks(QUERY_BLOCK, False), "ids binary, vectors binary"), "ann-queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, first, second, reach, asking, q in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "first", "second", "reach", "query_ids", "queries")), strict=True):
                ids, asking = np.frombuffer(ids, np.int64), np.frombuffer(asking, np.int64)
                q = np.frombuffer(q, kind).reshape(len(asking), -1).astype(np.float64)
                codes = [np.frombuffer(c, np.uint8).reshape(-1, len(ids)) for c in (first, second)]
                block = Coded(quantiser, ids, np.frombuffer(x, kind).reshape(len(ids), -1), *codes, *np.frombuffer(reach, np.float64).reshape(2, -1))
                found = [block.nearest(int(a), v, nearest, rerank) for a, v in zip(asking, q, strict=True)]
                out = [(np.full(len(i), a), i, e) for a, (i, e, _) in zip(asking, found, strict=True)]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.concatenate([o[0] for o in out])), "vec_id": pa.array(np.concatenate([o[1] for o in out])), "score": pa.array(np.concatenate([o[2] for o in out]))})

    # A stated query set against all rows, block against block.
    met = coded.crossJoin(asked.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")))
    found = met.mapInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
