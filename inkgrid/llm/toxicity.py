"""Toxicity: a factorization machine over hashed terms, so that pairs of terms weigh beyond their sum.

Terms are words and stems, so that inflected and compound forms of one stem speak together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.bytescan import Chunk, chunks
from inkgrid.llm.features import bounded_labels, distinct_terms, labelled_features, sigmoid, sums_by_row

BITS = 18
FACTORS = 4
MAX_LABELLED = 12_000
TOXIC_AT = 0.7
#: The penalty of a weight in units of its gradient's noise, the evidence (standard deviations) that halves it, and the penalty of
#: factors, which a term's own lean does not touch. Chosen by log loss over four folds of training rows (sf0.1), never on held-out rows.
PENALTY = 2.0
EVIDENCE = 6.0
FACTOR_PENALTY = 0.5


@dataclass
class ToxicityModel:
    bias: float
    linear: np.ndarray  # by bucket
    factors: np.ndarray  # (FACTORS, buckets)

    def raw(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + sums_by_row(self.linear[buckets], rows, n)
        for v in self.factors:
            x = v[buckets]
            z += 0.5 * (sums_by_row(x, rows, n) ** 2 - sums_by_row(x * x, rows, n))
        return z

    def score(self, chunk: Chunk) -> np.ndarray:
        rows, buckets = distinct_terms(chunk, BITS)
        known = (self.linear[buckets] != 0) | (self.factors[:, buckets] != 0).any(0)
        return sigmoid(self.raw(rows[known], buckets[known], chunk.rows))


class _Sums:
    """Sums over the entries of each group; ``groups`` and ``members`` are the two sides of the entries."""

    def __init__(self, groups: np.ndarray, members: np.ndarray, n: int) -> None:
        if (groups[1:] < groups[:-1]).any():
            order = np.argsort(groups, kind="stable")
            groups, members = groups[order], members[order]
        self.members = members.astype(np.int32, copy=False)
        self.at = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.groups = groups[self.at]
        self.n = n

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.groups] = np.add.reduceat(values.astype(np.float32)[self.members], self.at)
        return out


def _shrink(size: np.ndarray, by: np.ndarray, soft: float) -> np.ndarray:
    """Factors that draw sizes to zero by ``by``, and by the less the more they exceed ``soft``."""
    return np.maximum(0, 1 - by / (1 + size / soft) / np.maximum(size, 1e-12))


def train_row() -> F.Column:
    """Rows that may be learnt from; the rest are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = 200) -> ToxicityModel:
    """Fit on at most ``max_labelled`` rows outside the held-out third (bounded by this parameter).

    All terms that two rows share take part, whichever class they speak for and whether or not they
    do so alone. Weights and factors are held back by a penalty in units of what chance would give
    (a lasso of the weight, a group lasso of a term's factors), which fades as they grow. Without
    rows of both classes every text scores the smoothed share of toxic rows.
    """
    return fit_rows(labelled_features(documents, bounded_labels(labels, "toxic", max_labelled, train_row()), lambda c: [distinct_terms(c, BITS)]), epochs)


def fit_rows(rows: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]], epochs: int, penalty: float = PENALTY, evidence_at: float = EVIDENCE, factor_penalty: float = FACTOR_PENALTY) -> ToxicityModel:
    """The fit itself, on labels and buckets."""
    size = 1 << BITS
    label = np.array([r[0] for r in rows], float)
    share = (label.sum() + 1) / (len(label) + 10)
    bias = float(np.log(share / (1 - share)))
    linear, factors = np.zeros(size), np.zeros((FACTORS, size))
    if len(set(label.tolist())) < 2:
        return ToxicityModel(bias, linear, factors)
    d = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1][0][0]) for r in rows])
    b = np.concatenate([r[1][0][0] for r in rows]).astype(np.int32)
    n = len(rows)
    del rows  # the driver has little memory
    # A term of one row has nothing that it could be told from.
    held = np.bincount(b, minlength=size)
    known = np.flatnonzero(held > 1)
    if not len(known):
        return ToxicityModel(bias, linear, factors)
    shared = held[b] > 1
    number = np.zeros(size, np.int32)
    number[known] = np.arange(len(known))
    d, local = d[shared], number[b[shared]]
    del b, shared
    by_row, by_term = _Sums(d, local, n), _Sums(local, d, len(known))
    del d, local
    theta = np.concatenate([np.zeros((1, len(known))), 0.05 * np.random.default_rng(7).standard_normal((FACTORS, len(known)))])
    m, s, mb, sb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    # Both classes weigh the same in the fit, so that a fixed threshold means the same at any share of toxic rows.
    use = np.where(label > 0, 0.5 / label.sum(), 0.5 / (n - label.sum()))
    # What a term's gradient would be by chance alone; terms with evidence of their own are held back less.
    noise = 0.5 * np.sqrt(by_term(use * use))
    evidence = by_term(0.5 * use * np.sign(label - 0.5)) / noise
    own = penalty * noise / (1 + (evidence / evidence_at) ** 4)
    paired = factor_penalty * noise
    for step in range(1, epochs + 1):
        total = [by_row(x) for x in theta]
        z = bias + total[0] + 0.5 * (sum(t * t for t in total[1:]) - by_row((theta[1:] ** 2).sum(0)))
        error = (sigmoid(z) - label) * use
        g = 1e-4 * theta
        flat = by_term(error)
        g[0] += flat
        for f in range(1, FACTORS + 1):
            g[f] += by_term(error * total[f]) - theta[f] * flat
        gb = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        warm, fix = 1 - 0.9**step, np.sqrt(1 - 0.99**step)
        rate = 0.05 / (np.sqrt(s) / fix + 0.3 * noise + 1e-9)
        theta -= rate / warm * m
        bias -= 0.05 / warm * mb / (np.sqrt(sb) / fix + 1e-6)
        theta[0] *= _shrink(np.abs(theta[0]), rate[0] * own, 0.2)
        partners = np.sqrt(sum((t * t).mean() for t in total[1:]))
        theta[1:] *= _shrink(np.sqrt((theta[1:] ** 2).sum(0)), rate[1:].mean(0) * paired * partners, 0.5)
    linear[known] = theta[0]
    factors[:, known] = theta[1:]
    return ToxicityModel(float(bias), linear, factors)


SCHEMA = "doc_id long, score double, predicted int"


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, toxic_at: float = TOXIC_AT) -> DataFrame:
    """One row per document with its toxicity in [0, 1] and the verdict at ``toxic_at``.

    Null and empty texts get the score of a text without terms. Only ``text`` feeds a score; other
    columns, whatever their names, are not read. Null ids stay null, repeated rows give repeated rows,
    an empty table gives an empty result.
    """
    model = fit_toxicity(documents, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                score = model.score(chunk)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(chunk.first, chunk.rows), "score": pa.array(score), "predicted": pa.array((score >= toxic_at).astype(np.int32))})

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def remove_toxic(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of ``documents`` below ``toxic_at``, with all their columns, whatever their names: a filter inside the scan, without a join."""
    model = fit_toxicity(documents, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(c) for c in chunks(batch.column("text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.filter(pa.array(score < toxic_at))

    return documents.mapInArrow(run, documents.schema)
