"""Mixing to target weights: soft domain memberships, and document rates by projected gradient least squares.

A classifier fitted on the labelled table gives every document a posterior over domains. With ``n``
tokens and posterior ``p`` a document at rate ``r`` adds ``r n p`` to the expected tokens of the
domains. The rates start at 1 and follow ``r <- max(floor, r - p . M^-1 (S - t))``: ``S`` are the
expected tokens, ``t`` the targets and ``M`` the token-weighted second moments of the posteriors of the
documents above the floor, which scale the least squares so that a step solves them while no other
document meets the floor; where a step gains little, the next one takes the moments of all. A step needs one sum per domain over a compact
table of posteriors; a document's rate follows from its own posterior and the steps so far. A floor
of 1 keeps every document: the total is then the least one tried at which no domain has to shrink
and the projected rates still meet the targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.bytescan import NON_SPACE, Chunk, chunks, words
from inkgrid.llm.features import labelled_features, stacked, sums_by_row, unit_hash, word_and_char_grams
from inkgrid.llm.shared import materialise
from inkgrid.llm.tokens import encoded

BITS = 16
MAX_LABELLED = 2000
STEPS = 8
TOLERANCE = 1e-6
#: Totals tried between the least that shrinks no domain and that at which no rate is projected, the last one included.
TOTALS = 3
#: Share of the residual that a step must take off for the fit to go on, and below which it counts as little.
LEAST_GAIN, LITTLE = 0.1, 0.5
#: The production domains and the weights of their tokens.
WEIGHTS = {"low": 0.1, "high": 0.9}


@dataclass
class DomainModel:
    weights: np.ndarray  # (domains, tables * buckets)
    bias: np.ndarray

    def posteriors(self, chunk: Chunk) -> np.ndarray:
        z = np.tile(self.bias, (chunk.rows, 1))
        for t, (rows, buckets) in enumerate(word_and_char_grams(chunk, BITS)):
            n = np.maximum(np.bincount(rows, minlength=chunk.rows), 1)
            for d in range(len(self.bias)):
                z[:, d] += sums_by_row(self.weights[d, buckets + (t << BITS)], rows, chunk.rows) / n
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_domains(documents: DataFrame, labelled: DataFrame, n_domains: int, max_labelled: int = MAX_LABELLED, epochs: int = 60) -> DomainModel:
    """Softmax regression on at most ``max_labelled`` rows (doc_id, domain number); without rows every domain is as likely.

    Every fifth row is held out and sets the temperature, so that posteriors are as sure as they are right.
    """
    chosen = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").between(0, n_domains - 1)).groupBy("doc_id").agg(F.max("domain").cast("int").alias("label"))
    rows = labelled_features(documents, chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), lambda c: word_and_char_grams(c, BITS))
    width = 3 << BITS
    w, bias = np.zeros((n_domains, width)), np.zeros(n_domains)
    if not rows:
        return DomainModel(w, bias)
    label = np.array([r[0] for r in rows])
    d, b, v = stacked(rows, 1 << BITS)
    scale = 1.0 / np.sqrt(np.bincount(b, weights=v * v, minlength=width) / len(rows) + 1e-8) / 30.0
    v = (v * scale[b]).astype(np.float32)
    target = np.eye(n_domains)[label]
    held = np.arange(len(rows)) % 5 == 4
    m, s = np.zeros_like(w), np.zeros_like(w)
    mb, sb = np.zeros_like(bias), np.zeros_like(bias)
    for step in range(1, epochs + 1):
        z = np.stack([np.bincount(d, weights=v * w[k, b], minlength=len(rows)) for k in range(n_domains)], 1) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) / len(rows) * ~held[:, None]
        g = np.stack([np.bincount(b, weights=v * error[d, k], minlength=width) for k in range(n_domains)]) + 1e-5 * w
        gb = error.sum(0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.1 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        w -= rate * m / (np.sqrt(s) + 1e-7)
        bias -= rate * mb / (np.sqrt(sb) + 1e-7)
    z = (np.stack([np.bincount(d, weights=v * w[k, b], minlength=len(rows)) for k in range(n_domains)], 1) + bias)[held]

    def loss(temperature: float) -> float:
        y = z / temperature
        y = y - y.max(1, keepdims=True)
        return float((np.log(np.exp(y).sum(1)) - y[np.arange(len(y)), label[held]]).sum())

    best = min(1.5 ** np.arange(0, 16), key=loss) if held.any() else 1.0
    return DomainModel(w * scale / best, bias / best)


def rates(posteriors: np.ndarray, steps: list[np.ndarray], floor: float = 0.0) -> np.ndarray:
    """Document rates after projected gradient steps."""
    r = np.ones(len(posteriors))
    for step in steps:
        r = np.maximum(floor, r - posteriors @ step)
    return r


def expected(table: DataFrame, n_domains: int, taken: list[np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of the domains after the steps ``taken``, and the second moments of the documents above the floor (of all before the first step): one distributed sum of a few numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moment = np.zeros(n_domains), np.zeros((n_domains, n_domains))
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n_tokens").to_numpy().astype(float)
                p = batch.column("p").flatten().to_numpy().reshape(-1, n_domains)
                r = rates(p, taken, floor)
                total += (r * n) @ p
                free = r > floor if taken else slice(None)
                moment += (p[free] * n[free, None]).T @ p[free]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(n_domains * (n_domains + 1)), pa.int32()), "x": pa.array(np.concatenate([total, moment.ravel()]))})

    got = {r["place"]: r["x"] for r in table.mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()}
    every = np.array([got.get(i, 0.0) for i in range(n_domains * (n_domains + 1))])
    return every[:n_domains], every[n_domains:].reshape(n_domains, n_domains)


def fit_rates(table: DataFrame, goal: np.ndarray, floor: float = 0.0, steps: int = STEPS) -> tuple[list[np.ndarray], float]:
    """The steps, and the largest domain's residual as a share of the total; ``table`` has ``n_tokens`` and the array ``p``."""
    taken: list[np.ndarray] = []
    was, every = np.inf, None
    while True:
        total, moment = expected(table, len(goal), taken, floor)
        every = moment if every is None else every
        away = float(np.abs(total - goal).max() / max(1.0, goal.sum()))
        if away <= TOLERANCE or len(taken) == steps or away > (1 - LEAST_GAIN) * was:
            return taken, away
        scale, was = every if away > LITTLE * was else moment, away
        taken.append(np.linalg.pinv(scale) @ (total - goal))


def cover(weights: list[float], margin: float = 1e-6) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Targets at the least total whose rates are all 1 or more, so that no document is lost to the mix.

    The fitted rate of a document wholly in domain ``d`` is the total times ``(M^-1 w)_d``, and other
    rates lie between those. Where some domain cannot be left alone by any total, the total is the
    least at which no wanted domain shrinks.
    """

    def targets(total: np.ndarray, moment: np.ndarray) -> np.ndarray:
        w = np.array(weights) / sum(weights)
        least = (np.linalg.pinv(moment) @ w).min()
        return w * (1 + margin) * (1 / least if least > 1e-9 / max(1.0, total.sum()) else max([total[d] / w[d] for d in range(len(w)) if w[d] > 0]))

    return targets


@dataclass
class Mixture:
    """A fitted mix, applied to documents where they lie; ``away`` is how far the shares stay from the targets."""

    model: DomainModel
    steps: list[np.ndarray]
    floor: float
    away: float

    def of(self, posteriors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and whole copies: a rate's fraction is drawn by a hash of the id."""
        r = rates(posteriors, self.steps, self.floor)
        return r, np.floor(r + 1e-9 + (1 - 2e-9) * unit_hash(ids)).astype(np.int64)


def memberships(documents: DataFrame, model: DomainModel, tokenizer: str | None = None) -> DataFrame:
    """Written table of doc_id, n_tokens and posteriors ``p``. Tokens are words between white space, or ids of ``tokenizer``."""
    n_domains = len(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.rows)
                if tokenizer:
                    n = np.array([len(ids) for _, held in encoded(iter([part]), tokenizer) for ids in held], np.int64)
                else:
                    n = np.bincount(words(chunk, NON_SPACE)[2], minlength=chunk.rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1) * n_domains, pa.int32()), pa.array(model.posteriors(chunk).ravel()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "p": flat})

    return materialise(documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>"), "mixing")


def fit_mixture(documents: DataFrame, labelled: DataFrame, weights: list[float], floor: float = 1.0, max_labelled: int = MAX_LABELLED, tokenizer: str | None = None) -> tuple[Mixture, DataFrame]:
    """Rates that bring the documents' expected token totals to ``weights``, and the table of their memberships.

    With a floor of 1 totals are tried above the least that shrinks no domain, up to ``cover``'s; below
    1 the total stays that of the documents. Where posteriors are too soft for the weights at any of
    them, the rates are those of the nearest shares, and no document goes below the floor.
    """
    model = fit_domains(documents, labelled, len(weights), max_labelled)
    table = memberships(documents, model, tokenizer)
    total, moment = expected(table, len(weights), [], floor)
    w = np.array(weights) / sum(weights)
    if not total.sum():
        return Mixture(model, [], floor, 0.0), table
    totals = [total.sum()]
    if floor >= 1:
        low = floor * max(total[d] / w[d] for d in range(len(w)) if w[d] > 0)
        high = max(low, cover(weights)(total, moment).sum())
        totals = [low * (high / low) ** (i / TOTALS) for i in range(1, TOTALS + 1)] if high > low else [low]
    best = None
    for size in totals:
        steps, away = fit_rates(table, w * size, floor)
        if best is None or away < best.away:
            best = Mixture(model, steps, floor, away)
        if away <= TOLERANCE:
            break
    return best, table


def quality_domain() -> Column:
    """The production domain of a row of ``labels``."""
    return F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


def _numbered(labels: DataFrame, domain: Column | None, names: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, names)), quality_domain() if domain is None else domain) - 1
    return labels.select("doc_id", place.cast("int").alias("domain"))


def mixing_rates(documents: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: Column | None = None, floor: float = 1.0, tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, a posterior p_<domain> for each domain of ``weights``, rate, copies.

    ``domain`` names the domain of a row of ``labels`` (its quality by default); rows of other domains are
    not learnt from. Null and empty texts have no tokens and a posterior all the same; null ids draw
    like id 0; repeated rows count each; an empty table gives an empty result; columns besides
    ``doc_id`` and ``text`` are not read.
    """
    weights = weights or WEIGHTS
    mixture, table = fit_mixture(documents, _numbered(labels, domain, list(weights)), list(weights.values()), floor, tokenizer=tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, len(weights))
            r, copies = mixture.of(p, batch.column("doc_id").fill_null(0).to_numpy())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), **{f"p_{d}": pa.array(p[:, i]) for i, d in enumerate(weights)}, "rate": pa.array(r), "copies": pa.array(copies)})

    return table.mapInArrow(run, f"doc_id long, n_tokens long, {', '.join(f'`p_{d}` double' for d in weights)}, rate double, copies long")


def mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: Column | None = None, floor: float = 1.0, tokenizer: str | None = None) -> DataFrame:
    """The rows of ``documents``, each as often as its copies say, with all columns; with a floor of 1 none is lost."""
    weights = weights or WEIGHTS
    mixture, _ = fit_mixture(documents, _numbered(labels, domain, list(weights)), list(weights.values()), floor, tokenizer=tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            for chunk in chunks(batch.column("text")):
                _, copies = mixture.of(mixture.model.posteriors(chunk), ids[chunk.first : chunk.first + chunk.rows])
                # Copies of a row follow each other, a bounded number of rows at a time.
                at = np.repeat(np.arange(chunk.rows), copies) + chunk.first
                for i in range(0, len(at), 2000):
                    yield batch.take(pa.array(at[i : i + 2000]))

    return documents.mapInArrow(run, documents.schema)
