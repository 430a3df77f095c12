"""Personal data: patterns, and terms that disclose a protected entity by how the corpus uses them.

Protected entities are each distinct e-mail address, IP address, card or phone number and each quoted
secret (``value``), and the classes that such values recur in (``class``): the domain of an address, the
network of an IP address, the issuer of a card, the area of a phone, and each of the five kinds as a
whole. A term discloses an entity as far as the pointwise mutual information of the two reaches the
information of the entity itself: ``PMI(t, e) / IC(e)`` with ``PMI = log(N n(t,e) / (n(t) n(e)))`` and
``IC = log(N / n(e))``, counted over whole documents; 1 means that whoever reads the term knows the
entity. Terms at or above ``REMOVE_AT`` are removed, those at or above ``GENERALISE_AT`` are generalised.
Copies prove nothing: a term needs ``MIN_CONTEXTS`` different contexts around it and a value, or
``MIN_VALUES`` different values of a class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkgrid.llm.bytescan import ALNUM, LOWER, Chunk, chunks, mix, prefix_hash, span_hash, words
from inkgrid.llm.shared import materialise, unused

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The parts of an address beside its sign, and an IP address from the first digit of a run on: no position is tried twice.
BEFORE_AT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
FROM_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
FROM_RUN = re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)
#: A quoted run of 20 or more letters and digits, with both among them.
SECRET = re.compile(r"[\"']([A-Za-z0-9+/_=-]{20,})[\"']")
CONTEXT = 8  # words on either side of a value and of a term that tell contexts apart
MIN_CONTEXTS = 3
MIN_VALUES = 5
REMOVE_AT = 0.95
GENERALISE_AT = 0.8
#: Terms whose hashes (8 bytes each) may be broadcast; more are matched by a shuffle.
MAX_BROADCAST_TERMS = 200_000
#: Share of a batch's documents from which a term counts as usual there.
USUAL = 0.005
#: Pairs of entities and terms that a task holds before it sums them.
PAIRS = 1 << 20
#: Bits of a hash that name its cell in the filters ahead of a shuffle: of terms (2 MB), at most of entities (16 MB).
CELL_BITS = 24
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
QUOTE = np.isin(np.arange(256), list(b"\"'"))

Spans = list[tuple[str, int, int]]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in value.split(".") if p.strip("0"))
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, found from their signs: each goes back to where its run begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(BEFORE_AT))
        m = FROM_AT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> Spans:
    """Matches of the base patterns by kind and start, in code points; linear in the text."""
    out: Spans = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", FROM_RUN), ("card", PATTERNS["card"]), ("phone", PATTERNS["phone"])):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


def secret_spans(text: str) -> Spans:
    """Quoted secrets without their quotes."""
    if '"' not in text and "'" not in text:
        return []
    found = [m for m in SECRET.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    return [("secret", *m.span(1)) for m in found]


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _group(kind: str, value: str) -> str:
    """The class that a value recurs in: domain, network, issuer or area."""
    if kind == "email":
        return value.rpartition("@")[2].lower()
    if kind == "ip":
        return ".".join(value.split(".")[:2])
    digits = "".join(c for c in value if "0" <= c <= "9")
    return {"card": digits[:6], "phone": digits[:4]}.get(kind, "")


def entities(text: str, spans: Spans) -> tuple[dict[int, tuple[int, int]], dict[int, set[int]]]:
    """Value entities with the place of their first value (even numbers), and class entities with their values (odd numbers)."""
    values: dict[int, tuple[int, int]] = {}
    classes: dict[int, set[int]] = {}
    for kind, a, b in spans:
        value = text[a:b]
        one = _digest(f"{kind}:{value.lower()}") & ~1
        values.setdefault(one, (a, b))
        for name in {f"class:{kind}:{_group(kind, value)}", f"class:{kind}:"}:
            classes.setdefault(_digest(name) | 1, set()).add(one)
    return values, classes


def _least_support(column: str) -> Column:
    return F.when(F.col(column).bitwiseAND(1) == 1, MIN_VALUES).otherwise(MIN_CONTEXTS)


def _might_match(chunk: Chunk) -> np.ndarray:
    """Texts with a digit, an at sign or a quote; the others hold no value."""
    seen = np.concatenate([[0], np.cumsum(DIGIT[chunk.buf] | QUOTE[chunk.buf] | (chunk.buf == 0x40))])
    return seen[chunk.ends] > seen[chunk.starts]


def _text(chunk: Chunk, i: int) -> str:
    return chunk.buf[chunk.starts[i] : chunk.ends[i]].tobytes().decode()


def _neighbours(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for each term of the up to ``CONTEXT`` terms on either side of it in its text."""
    out = np.zeros(len(hashes), np.uint64)
    for step in range(1, CONTEXT + 1):
        same = row[step:] == row[:-step]
        out[step:] += np.where(same, mix(hashes[:-step] + np.uint64(2 * step)), np.uint64(0))
        out[: len(out) - step] += np.where(same, mix(hashes[step:] + np.uint64(2 * step + 1)), np.uint64(0))
    return mix(out)


def _summed(keys: dict[str, np.ndarray], times: np.ndarray | None = None) -> pa.RecordBatch:
    """Each distinct row of ``keys`` with how often it stands there, or the sum of ``times``."""
    columns = list(keys.values())
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(order))) if times is None else np.add.reduceat(times[order], begin) if len(order) else times
    return pa.RecordBatch.from_pydict({name: pa.array(c[begin].view(np.int64)) for name, c in zip(keys, columns, strict=True)} | {"n": pa.array(n.astype(np.int64))})


def _merged_counts(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of several counts, and the sums."""
    term, n = (np.concatenate(x) for x in zip(*counted, strict=True))
    distinct, place = np.unique(term, return_inverse=True)
    return distinct, np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)


def _first_counts(documents: DataFrame) -> DataFrame:
    """In how many documents each protected entity stands, and how (entity, n, p1, p2), and for usual terms a lower bound of theirs (term, n): the documents of the batches in which they are usual.

    ``p1`` and ``p2`` digest an entity's profile. Of a value it is the sets of documents in which it stands
    beside the same words, of a class the sets of documents in which each of its values stands. Which
    words these are makes no difference to what any term discloses, so entities of one profile are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            counted: list[tuple[np.ndarray, np.ndarray]] = []
            for chunk in chunks(batch.column("text")):
                scanned = _terms(chunk)
                counted.append(_in_documents(scanned))
                for i, values, classes, begin, end, mine, _ in _beside(chunk, scanned, None):
                    digest = hashlib.blake2b(chunk.buf[chunk.starts[i] : chunk.ends[i]].tobytes(), digest_size=16).digest()
                    d1, d2 = np.frombuffer(digest, np.int64).tolist()
                    rows += [(key, int(_near(begin, end, mine, *place).view(np.int64)), d1, d2, 1) for key, place in values.items()]
                    for key, members in classes.items():
                        # A document counts once, with one of its values.
                        rows += [(key, m, d1, d2, int(not j)) for j, m in enumerate(sorted(members))]
            if not counted:
                continue
            term, n = _merged_counts(counted)
            usual = n >= max(2, USUAL * batch.num_rows)
            term, n = term[usual], n[usual]
            of = np.array(rows, np.int64).reshape(-1, 5).T
            none = pa.nulls(len(term), pa.int64())
            columns = {name: pa.concat_arrays([pa.array(x), none]) for name, x in zip(("entity", "mark", "d1", "d2"), of[:4], strict=True)}
            yield pa.RecordBatch.from_pydict(columns | {"term": pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(term.view(np.int64), pa.int64())]), "n": pa.concat_arrays([pa.array(of[4]), pa.array(n, pa.int64())])})

    total = lambda column: F.sum(column.cast("decimal(20,0)"))
    marks = documents.mapInArrow(run, "entity long, mark long, d1 long, d2 long, term long, n long").groupBy("entity", "mark", "term").agg(F.sum("n").alias("n"), total(F.col("d1")).alias("d1"), total(F.col("d2")).alias("d2"))
    return marks.groupBy("entity", "term").agg(F.sum("n").alias("n"), total(F.xxhash64("d1", "d2")).alias("p1"), total(F.xxhash64("d2", "d1", F.lit(1))).alias("p2"))


@dataclass
class Wanted:
    """Entities to look for and how many documents a term may stand in to disclose them; usual terms and at least how many they stand in.

    Entities are known by cells of their hashes, which hold the largest level (a fifth of a binary order)
    of their document counts, or 0: at most 16 MB for any number of entities. What else falls into a
    cell is ruled out later, by the entities' table.
    """

    shift: np.uint64
    levels: np.ndarray
    limits: np.ndarray  # by level
    usual: np.ndarray
    at_least: np.ndarray

    @classmethod
    def choose(cls, entities: DataFrame, terms: DataFrame, total: int, share: float) -> Wanted:
        """From written tables of entities (entity, n) and usual terms (term, n). ``PMI / IC`` is at least ``share`` only if ``n(t) <= N (n(e) / N) ** share``."""
        bits = min(max((16 * entities.count()).bit_length(), 10), CELL_BITS)
        level = (F.ceil(F.log2("n") * 5) + 1).cast("int")
        found = entities.groupBy(F.shiftrightunsigned("entity", 64 - bits).cast("int").alias("cell")).agg(F.max(level).alias("level")).toArrow()
        levels = np.zeros(1 << bits, np.uint8)
        levels[found["cell"].to_numpy()] = found["level"].to_numpy()
        most = 2.0 ** (np.arange(-1, 255) / 5)
        limits = total * (most / max(total, 1)) ** share * (1 + 1e-9)
        # Terms of that share of the documents are few: no more than a document's mean number of terms over USUAL.
        usual = terms.where(F.col("n") >= USUAL * total).select("term", "n").toArrow()
        term = usual["term"].to_numpy().view(np.uint64)
        by_term = np.argsort(term)
        return cls(np.uint64(64 - bits), levels, limits, term[by_term], usual["n"].to_numpy()[by_term])

    def known(self, keys: list[int]) -> set[int]:
        """Those of ``keys`` that are looked for, and a few others."""
        of = np.array(keys, np.int64)
        return set(of[self.levels[of.view(np.uint64) >> self.shift] > 0].tolist())

    def least(self, terms: np.ndarray) -> np.ndarray:
        """In how many documents each of ``terms`` stands at least."""
        out = np.zeros(len(terms), np.int64)
        known = _member(self.usual, terms)
        out[known] = self.at_least[np.searchsorted(self.usual, terms[known])]
        return out

    def limit(self, key: int) -> float:
        return self.limits[self.levels[np.array([key], np.int64).view(np.uint64) >> self.shift][0]]


def _outside(begin: np.ndarray, end: np.ndarray, spans: Spans) -> np.ndarray:
    """Which of the places ``begin`` to ``end`` meet no span: as many spans have ended before as have begun before the end."""
    starts, ends = np.array(sorted(a for _, a, _ in spans), np.int64), np.array(sorted(b for _, _, b in spans), np.int64)
    return np.searchsorted(ends, begin, side="right") == np.searchsorted(starts, end, side="left")


def _near(begin: np.ndarray, end: np.ndarray, mine: np.ndarray, a: int, b: int) -> np.uint64:
    """One hash for the free terms ``mine`` beside the span from ``a`` to ``b``."""
    low, high = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(begin, b, side="left"))
    near = np.concatenate([mine[max(0, low - CONTEXT) : low], mine[high : high + CONTEXT]]).tobytes()
    return np.frombuffer(hashlib.blake2b(near, digest_size=8).digest(), np.uint64)[0]


def _beside(chunk: Chunk, scanned: tuple[np.ndarray, ...], wanted: Wanted | None) -> Iterator[tuple]:
    """Of each text with a (wanted) entity: its row, value and class entities, and the terms outside all spans: begin, end, hash, and place among the chunk's."""
    might = np.flatnonzero(_might_match(chunk)).tolist()
    if not might or wanted is not None and not wanted.levels.any():
        return
    first, last, row, hashes = scanned
    at = np.searchsorted(row, np.arange(chunk.rows + 1))
    points = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
    for i in might:
        text = _text(chunk, i)
        spans = base_spans(text) + secret_spans(text)
        values, classes = entities(text, spans)
        if wanted is not None and spans:
            known = wanted.known([*values, *classes])
            values, classes = ({k: x for k, x in of.items() if k in known} for of in (values, classes))
        if not values and not classes:
            continue
        own = slice(at[i], at[i + 1])
        base = points[chunk.starts[i]]
        begin, end = points[first[own]] - base, points[last[own]] - base
        free = np.flatnonzero(_outside(begin, end, spans))
        yield i, values, classes, begin[free], end[free], hashes[own][free], at[i] + free


def _pairs(documents: DataFrame, wanted: Wanted) -> DataFrame:
    """What speaks for each wanted entity with each term that may disclose it: entity, term, n_both (documents), contexts (different ones, or values of a class).

    Rows without an entity count documents that hold the term, of each batch where it stands beside an
    entity: a lower bound that is sharp for terms in general use. Values of a class count up to the
    ``MIN_VALUES`` that prove it: a text that holds more gives the smallest of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[np.ndarray] = []
            counted: list[tuple[np.ndarray, np.ndarray]] = []
            for chunk in chunks(batch.column("text")):
                scanned = _terms(chunk)
                counted.append(_in_documents(scanned))
                around = None
                out: list[tuple[np.ndarray, ...]] = []
                size = 0
                each = []
                for _, values, classes, begin, end, mine, places in _beside(chunk, scanned, wanted):
                    distinct, index = np.unique(mine, return_index=True)
                    each.append(distinct)
                    least = wanted.least(distinct)
                    if values and around is None:
                        around = _neighbours(*scanned[2:])
                    for key, place in values.items():
                        may = least <= wanted.limit(key)
                        k = int(may.sum())
                        out.append((np.full(k, key, np.int64), distinct[may], mix(around[places[index[may]]] + _near(begin, end, mine, *place)), np.ones(k, np.int64)))
                        size += k
                        if size >= PAIRS:
                            yield _paired(out)
                            out, size = [], 0
                    for key, members in classes.items():
                        some = distinct[least <= wanted.limit(key)]
                        k = len(some)
                        # A document counts once, with one of its values.
                        out += [(np.full(k, key, np.int64), some, np.full(k, m, np.int64).view(np.uint64), np.full(k, int(not i), np.int64)) for i, m in enumerate(sorted(members)[:MIN_VALUES])]
                        size += k * min(len(members), MIN_VALUES)
                        if size >= PAIRS:
                            yield _paired(out)
                            out, size = [], 0
                if out:
                    yield _paired(out)
                if each:
                    seen.append(np.unique(np.concatenate(each)))
            if seen:
                beside = np.unique(np.concatenate(seen))
                # What is ruled out for all entities needs no bound.
                beside = beside[wanted.least(beside) <= wanted.limits[wanted.levels.max()]]
                term, n = _merged_counts(counted)
                alone = n[np.searchsorted(term, beside)]
                none = pa.nulls(len(beside), pa.int64())
                yield pa.RecordBatch.from_pydict({"entity": none, "term": pa.array(beside.view(np.int64)), "context": none, "n": pa.array(alone)})

    found = documents.mapInArrow(run, "entity long, term long, context long, n long").groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    return found.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))


def _paired(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    entity, term, context, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return _summed({"entity": entity, "term": term, "context": context}, n)


def disclosures(documents: DataFrame, at_least: float = GENERALISE_AT) -> DataFrame:
    """Terms that disclose an entity by ``at_least``, and how far each discloses the one it discloses most: term (hash), disclosure.

    Everything is counted over whole documents and pre-aggregated before each shuffle. Entities of
    fewer documents than their support needs, and pairs of less support, are not counted further;
    neither are usual terms that stand in too many documents for an entity, nor pairs that the documents
    of the batches where a term stands beside an entity alone put below ``at_least``. Of entities that
    stand in the same documents in the same way, as the values of a list that is copied do, one stands for all.
    An entity of all documents has no information to disclose.
    """
    documents = documents.select("text")
    total = documents.count()
    found = materialise(_first_counts(documents).where(F.col("entity").isNull() | (F.col("n") >= _least_support("entity")) & (F.col("n") < total)), "pii-counts")
    alike = found.where("entity is not null").groupBy(F.col("entity").bitwiseAND(1), "p1", "p2").agg(F.min("entity").alias("entity"), F.min("n").alias("n"))
    entities = materialise(alike.select("entity", "n"), "pii-entities")
    wanted = Wanted.choose(entities, found.where("term is not null"), total, at_least)
    counts = entities.select("entity", F.col("n").alias("n_entity"))
    grouped = materialise(_pairs(documents, wanted).where(F.col("entity").isNull() | (F.col("contexts") >= _least_support("entity"))), "pii-grouped")
    least = grouped.where(F.col("entity").isNull()).select("term", F.col("n_both").alias("n_least"))
    n = F.lit(float(max(total, 1)))
    ic = F.log(n / F.col("n_entity"))
    pmi = lambda n_term: F.log(n * F.col("n_both") / (F.col(n_term) * F.col("n_entity")))
    pairs = grouped.where(F.col("entity").isNotNull()).join(counts, "entity").join(least, "term").where(pmi("n_least") >= at_least * ic - 1e-9)
    pairs = materialise(pairs.select("entity", "term", "n_both", "n_entity"), "pii-pairs")
    n_term = _document_counts(documents, pairs.select("term").distinct())
    return pairs.join(n_term, "term").groupBy("term").agg(F.max(pmi("n_term") / ic).alias("disclosure")).where(F.col("disclosure") >= at_least - 1e-12)


def _document_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents each of ``terms`` stands: term, n_term."""
    size = terms.count()
    if not size:
        return terms.select("term", F.lit(0).cast("long").alias("n_term"))
    wanted = np.sort(np.array([r[0] for r in terms.collect()], np.int64).view(np.uint64)) if size <= MAX_BROADCAST_TERMS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                term, n = _in_documents(_terms(chunk), wanted)
                if wanted is not None:
                    held[np.searchsorted(wanted, term)] += n
                    continue
                yield pa.RecordBatch.from_pydict({"term": pa.array(term.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})
        seen = np.flatnonzero(held)
        if len(seen):
            yield pa.RecordBatch.from_pydict({"term": pa.array(wanted[seen].view(np.int64), pa.int64()), "n": pa.array(held[seen], pa.int64())})

    counted = documents.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted if wanted is not None else counted.join(terms, "term", "left_semi")


def _terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lowered = Chunk(chunk.first, chunk.rows, LOWER[chunk.buf], chunk.starts, chunk.ends)
    first, last, row = words(lowered, ALNUM)
    return first, last, row, span_hash(prefix_hash(lowered.buf), first, last)


def _in_documents(scanned: tuple[np.ndarray, ...], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (wanted) terms of a scanned chunk, and in how many of its texts each stands."""
    _, _, row, hashes = scanned
    if wanted is not None:
        known = _member(wanted, hashes)
        row, hashes = row[known], hashes[known]
    order = np.lexsort((row, hashes))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return np.unique(hashes[fresh], return_counts=True)


def _member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _points(chunk: Chunk, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions as code points of their text."""
    points = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
    return points[at] - points[chunk.starts[row]]


def spans_of(chunk: Chunk, removed: np.ndarray, generalised: np.ndarray) -> Iterator[tuple[Spans, Spans]]:
    """Base spans of each text of a chunk, and its secrets and disclosing terms; terms inside other spans are covered already."""
    first, last, row, hashes = _terms(chunk) if len(removed) or len(generalised) else (np.zeros(0, np.int64),) * 4
    kinds: list[Spans] = [[] for _ in range(chunk.rows)]
    for kind, wanted in (("term", removed), ("general", generalised)):
        hit = np.flatnonzero(_member(wanted, hashes))
        if len(hit):
            for r, a, b in zip(row[hit].tolist(), _points(chunk, row[hit], first[hit]).tolist(), _points(chunk, row[hit], last[hit]).tolist(), strict=True):
                kinds[r].append((kind, a, b))
    might = _might_match(chunk)
    for i in range(chunk.rows):
        text = _text(chunk, i) if might[i] else ""
        base = base_spans(text)
        yield base, _added(base, secret_spans(text), kinds[i])


def _added(base: Spans, secrets: Spans, terms: Spans) -> Spans:
    """Secrets outside base spans, and terms outside both."""
    for found in (secrets, terms):
        if found and (base or found is terms):
            taken = base if found is secrets else base + secrets
            free = _outside(np.array([a for _, a, _ in found]), np.array([b for _, _, b in found]), taken) if taken else np.ones(len(found), bool)
            found[:] = [x for x, ok in zip(found, free.tolist(), strict=True) if ok]
    return secrets + terms


def _disclosing(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Sorted hashes of removed and generalised terms; or, beyond the broadcast bound, their table."""
    found = materialise(disclosures(documents).where(F.col("disclosure") >= GENERALISE_AT), "pii-terms")
    if found.count() > MAX_BROADCAST_TERMS:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), found
    rows = found.collect()
    pick = lambda ok: np.sort(np.array([r["term"] for r in rows if ok(r["disclosure"])], np.int64).view(np.uint64))
    return pick(lambda x: x >= REMOVE_AT), pick(lambda x: x < REMOVE_AT), None


def _shuffled_terms(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Term spans by a join, for more disclosing terms than may be broadcast: key, more (kind:start:end, joined by commas).

    A bitmap of the terms' cells goes ahead, so that usual words are not shuffled at all.
    """
    shift = 64 - CELL_BITS
    cells = np.zeros(1 << CELL_BITS, bool)
    cells[[r[0] for r in found.select(F.shiftrightunsigned("term", shift).alias("cell")).distinct().toLocalIterator()]] = True
    packed = np.packbits(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            keys = batch.column("key")
            for chunk in chunks(batch.column("text")):
                first, last, row, hashes = _terms(chunk)
                at = np.flatnonzero(known[hashes >> np.uint64(shift)])
                first, last, row, hashes = first[at], last[at], row[at], hashes[at]
                yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(row + chunk.first)), "term": pa.array(hashes.view(np.int64), pa.int64()), "start": pa.array(_points(chunk, row, first), pa.int64()), "end": pa.array(_points(chunk, row, last), pa.int64())})

    every = documents.select(F.md5("text").alias("key"), "text").where("key is not null").dropDuplicates(["key"]).mapInArrow(run, "key string, term long, start long, end long")
    kind = F.when(F.col("disclosure") >= REMOVE_AT, "term").otherwise("general")
    hits = every.join(found, "term").select("key", F.struct(kind.alias("kind"), "start", "end").alias("x"))
    return hits.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("more"))


def _map_spans(documents: DataFrame, schema: StructType | str, emit: Callable[[pa.RecordBatch, Chunk, list[tuple[Spans, Spans]]], pa.RecordBatch]) -> DataFrame:
    removed, generalised, many = _disclosing(documents)
    columns = documents.columns
    key, extra = unused(columns, "text_key"), unused(columns, "term_spans")
    if many is None:
        documents = documents.withColumn(extra, F.lit(None).cast("string"))
    else:
        found = _shuffled_terms(documents, many).withColumnsRenamed({"key": key, "more": extra})
        documents = documents.withColumn(key, F.md5("text")).join(found, key, "left").select(*columns, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(extra)
            batch = batch.drop_columns([extra])
            for chunk in chunks(batch.column("text")):
                found = list(spans_of(chunk, removed, generalised))
                if more.null_count < len(more):
                    for i, terms in enumerate(more.slice(chunk.first, chunk.rows).to_pylist()):
                        if terms:
                            base, secrets = found[i]
                            found[i] = (base, _added(base, secrets, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in terms.split(","))]))
                yield emit(batch, chunk, found)

    return documents.mapInArrow(run, schema)


def _joined(spans: Spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """One row per document with its base matches by kind and all spans as ``kind:start:end``.

    Null and empty texts have no span; repeated rows stay; an empty table gives an empty result;
    columns besides ``doc_id`` and ``text`` are not read.
    """

    def emit(batch: pa.RecordBatch, chunk: Chunk, found: list[tuple[Spans, Spans]]) -> pa.RecordBatch:
        count = {k: pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(chunk.first, chunk.rows), **{f"n_{k}": x for k, x in count.items()}, "base_sha256": pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]), "spans": pa.array([_joined([*base, *sorted(more, key=lambda x: (x[0], x[1]))]) for base, more in found])})

    return _map_spans(documents.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", emit)


def generalised(term: str) -> str:
    """What a term is an instance of: the decade of a year, the length of a number, else its shape."""
    if term.isdecimal():
        return f"[{term[:3]}0s]" if len(term) == 4 and term[:2] in ("19", "20") else f"[NUMBER OF {len(term)} DIGITS]"
    if any(c.isdecimal() for c in term):
        return "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitise(documents: DataFrame) -> DataFrame:
    """The same rows and columns; base matches become ``[EMAIL]`` and the like, secrets ``[SECRET]``, disclosing terms what they are an instance of, or ``[REDACTED]``.

    Overlapping spans are replaced together, under the first one's name. ``n_chars``, where there is
    one, is counted anew. A null text stays null, an empty table empty; columns may have any name.
    """
    name = {"term": "[REDACTED]", "secret": "[SECRET]"} | {k: f"[{k.upper()}]" for k in KINDS}

    def emit(batch: pa.RecordBatch, chunk: Chunk, found: list[tuple[Spans, Spans]]) -> pa.RecordBatch:
        part = batch.slice(chunk.first, chunk.rows)
        if not any(a or b for a, b in found):
            return part
        texts = part.column("text").to_pylist()
        changed = []
        for i, (base, more) in enumerate(found):
            spans = sorted([*base, *more], key=lambda x: (x[1], -x[2]))
            if not spans:
                continue
            out, at, text = [], 0, texts[i]
            for kind, a, b in spans:
                if a >= at:
                    out += [text[at:a], generalised(text[a:b]) if kind == "general" else name[kind]]
                at = max(at, b)
            texts[i] = "".join([*out, text[at:]])
            changed.append(i)
        columns = {n: part.column(n) for n in part.schema.names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            kind, counts = columns["n_chars"].type, columns["n_chars"].to_pylist()
            for i in changed:
                counts[i] = len(texts[i])
            columns["n_chars"] = pa.array(counts, kind)
        return pa.RecordBatch.from_pydict(columns)

    return _map_spans(documents, StructType(documents.schema.fields), emit)
