"""Quality rules: fixed counting rules, and a hashed n-gram logistic regression with calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkgrid.llm.bytescan import NON_SPACE, Chunk, chain, chunks, keyed, per_row, prefix_hash, span_hash, words
from inkgrid.llm.features import bounded_labels, labelled_features, sigmoid, stacked, sums_by_row, word_and_char_grams

BITS = 16
MAX_LABELLED = 3000
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass
class QualityModel:
    """Weights by table and bucket on mean n-gram counts, then Platt's two numbers."""

    weights: np.ndarray  # (3, 1 << BITS)
    bias: float
    slope: float
    offset: float

    def score(self, chunk: Chunk) -> np.ndarray:
        z = np.full(chunk.rows, self.bias)
        for table, (rows, buckets) in zip(self.weights, word_and_char_grams(chunk, BITS), strict=True):
            n = np.maximum(np.bincount(rows, minlength=chunk.rows), 1)
            z += sums_by_row(table[buckets], rows, chunk.rows) / n
        return sigmoid(self.slope * z + self.offset)


def fit_quality(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = 60) -> QualityModel:
    """Fit on at most ``max_labelled`` labelled rows (bounded by this parameter, not by the data).

    Four fifths fit the weights, one fifth the calibration. Without rows of both classes the model
    gives every text 0.5.
    """
    rows = labelled_features(documents, bounded_labels(labels, "quality", max_labelled), lambda c: word_and_char_grams(c, BITS))
    width = 1 << BITS
    weights, bias = np.zeros(3 * width), 0.0
    label = np.array([r[0] for r in rows], float)
    if len(set(label.tolist())) < 2:
        return QualityModel(weights.reshape(3, width), 0.0, 1.0, 0.0)
    # A row can only weigh what other rows share: a bucket of a single row carries no evidence.
    d, b, v = stacked(rows, width)
    # Scale each bucket by its root mean square, so that rare and frequent grams learn alike.
    scale = 1.0 / np.sqrt(np.bincount(b, weights=v * v, minlength=3 * width) / len(rows) + 1e-8)
    v = (v * scale[b] / 30.0).astype(np.float32)
    held = np.arange(len(rows)) % 5 == 4
    use = np.where(held, 0.0, np.where(label > 0, 0.5 / max(1, (label[~held] > 0).sum()), 0.5 / max(1, (label[~held] == 0).sum())))
    m, s, mb, sb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = np.bincount(d, weights=v * weights[b], minlength=len(rows)) + bias
        error = (sigmoid(z) - label) * use
        g = np.bincount(b, weights=v * error[d], minlength=len(weights)) + 1e-5 * weights
        gb = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.1 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        weights -= rate * m / (np.sqrt(s) + 1e-7)
        bias -= rate * mb / (np.sqrt(sb) + 1e-7)
    z = np.bincount(d, weights=v * weights[b], minlength=len(rows)) + bias
    slope, offset = platt(z[held], label[held])
    return QualityModel((weights * scale / 30.0).reshape(3, width), bias, slope, offset)


def platt(z: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's calibration with his smoothed targets, by damped Newton steps."""
    positive, negative = (label > 0).sum(), (label == 0).sum()
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def rule_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counting rules' figures for each text of a chunk."""
    n = chunk.rows
    first, last, row = words(chunk, NON_SPACE)
    prefix = prefix_hash(chunk.buf)
    hashes = span_hash(prefix, first, last)
    # Code points: bytes that do not continue a character, counted within words (white space is ASCII).
    starts_char = (chunk.buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char & NON_SPACE[chunk.buf])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[chunk.buf])])
    repeat = np.zeros(len(row), bool)
    if len(row) >= 3:
        whole = row[2:] == row[:-2]
        key = keyed(row[:-2], chain([hashes[:-2], hashes[1:-1], hashes[2:]]))
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        k = key[order]
        equal = k[1:] == k[:-1]
        again = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(k) else order
        for j in range(3):
            repeat[again + j] = True
    # Lines: cut at newlines and at the ends of texts; those with a word count.
    newline = np.flatnonzero(chunk.buf == 10)
    begin = np.sort(np.concatenate([chunk.starts, newline + 1]), kind="stable")
    finish = np.sort(np.concatenate([chunk.ends, newline]), kind="stable")
    filled = np.searchsorted(first, finish, side="left") > np.searchsorted(first, begin, side="left")
    begin, finish = begin[filled], finish[filled]
    line_row = chunk.of(begin)
    lines = keyed(line_row, span_hash(prefix, begin, finish))
    kept = np.unique(lines) >> np.uint64(48)
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": chars[chunk.ends] - chars[chunk.starts],
        "n_symbols": symbols[chunk.ends] - symbols[chunk.starts],
        "n_dup_lines": np.bincount(line_row, minlength=n) - np.bincount(kept.astype(np.int64), minlength=n),
        "n_repeat_words": per_row(repeat, row, n),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def quality_rules(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document with its rule figures, calibrated quality and verdict.

    Null and empty texts have no words and fail the base rules; null ids stay null; repeated rows
    give repeated rows; an empty table gives an empty result; columns besides ``doc_id`` and
    ``text`` are not read. Windows and lines are compared within a text by 48-bit hashes.
    """
    model = fit_quality(documents, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                c = rule_counts(chunk)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                quality = model.score(chunk)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(chunk.first, chunk.rows), **{k: pa.array(x, pa.int64()) for k, x in c.items()}, "base_failed": pa.array(failed), "quality": pa.array(quality), "kept": pa.array(~failed & (quality >= keep_at))})

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
