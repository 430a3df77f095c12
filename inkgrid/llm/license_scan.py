"""License scans: phrases, and an exact set-similarity join of text blocks with license notices.

A block is a window of consecutive words, across line ends, ``WINDOW`` times as many as the notice
has. It matches a notice if it holds at least ``THRESHOLD`` of the notice's distinct words, and if
another label's notice would match as well by the words that both share, one of those that only this
notice has. Words are ordered by their frequency in the whole corpus, rarest first. A notice of
``n`` distinct words that needs ``o`` of them can only match a window that holds one of its first
``n - o + 1`` words (prefix filter, by an index from these words to their notices), in which ``o``
notice words stand at all (length filter), and in which ``o`` words can still follow the rarest one
shared (positional filter). What is left is counted. The prefix filter is asked at every place: it
is lengthened by up to ``DEEPER - 1`` words, and only where as many of its words as that lets one
expect stand within a window's length are the notice's words looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.bytescan import ALNUM, LOWER, Chunk, chunks, prefix_hash, span_hash, words

THRESHOLD = 0.8
WINDOW = 1.5
#: Words of a lengthened prefix that a window must hold, if the notice needs as many.
DEEPER = 3
#: Notices whose prefix words are looked up at once.
NOTICE_BLOCK = 128
#: Notices that one scan may take; each worker holds them all.
MAX_NOTICES = 100_000
#: Phrases that label a text by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices as their licenses word them, and their labels.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_hashes(terms: list[bytes]) -> np.ndarray:
    """Hashes of single terms, as the scans compute them."""
    lengths = np.array([len(t) for t in terms], np.int64)
    ends = np.cumsum(lengths)
    return span_hash(prefix_hash(np.frombuffer(b"".join(terms), np.uint8)), ends - lengths, ends)


@dataclass
class Index:
    """Notices over word numbers; ``order`` has the sorted word hashes."""

    order: np.ndarray
    labels: list[str]
    notices: list[np.ndarray]  # word numbers, rarest first
    needed: list[int]
    spans: list[int]  # words of a window
    apart: list[list[np.ndarray]]  # for each notice of another label that matches by shared words alone: the words that only this one has
    by_word: list[tuple[np.ndarray, np.ndarray]]  # (word numbers, ranks) of each notice by word number
    prefixes: list[tuple[np.ndarray, np.ndarray]]  # of each block of notices: where the notices of a word begin, and these notices

    @classmethod
    def build(cls, notices: list[tuple[str, str]], threshold: float) -> Index:
        texts = [WORD.findall(text.lower().encode()) for _, text in notices]
        sets = [sorted(set(t)) for t in texts]
        universe = sorted({w for s in sets for w in s})
        hashes = word_hashes(universe)
        order = np.sort(hashes)
        number = dict(zip(universe, np.searchsorted(order, hashes).tolist(), strict=True))
        labels = [label for label, _ in notices]
        needed = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        apart = [[np.array([number[w] for w in words]) for words in found] for found in told_apart(labels, sets, needed)]
        return cls(order, labels, [np.array([number[w] for w in s]) for s in sets], needed, [math.ceil(WINDOW * len(t)) for t in texts], apart, [], [])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, or -1."""
        at = np.minimum(np.searchsorted(self.order, hashes), len(self.order) - 1)
        return np.where(self.order[at] == hashes, at, -1)

    def rank_by(self, counts: dict[int, int]) -> Index:
        notices = [np.array(sorted(n.tolist(), key=lambda w: (counts.get(w, 0), w))) for n in self.notices]
        by_word = []
        for notice in notices:
            ranks = np.argsort(notice)
            by_word.append((notice[ranks], ranks))
        prefixes = []
        for low in range(0, len(notices), NOTICE_BLOCK):
            block = range(low, min(low + NOTICE_BLOCK, len(notices)))
            held = [notices[k][: len(notices[k]) - self.needed[k] + self.deep(k)] for k in block]
            word, of = np.concatenate(held), np.repeat(np.array(block), [len(h) for h in held])
            by = np.lexsort((of, word))
            prefixes.append((np.searchsorted(word[by], np.arange(len(self.order) + 1)), of[by]))
        return Index(self.order, self.labels, notices, self.needed, self.spans, self.apart, by_word, prefixes)

    def deep(self, k: int) -> int:
        """How many words of notice ``k``'s lengthened prefix every matching window holds."""
        return min(DEEPER, self.needed[k])


def told_apart(labels: list[str], sets: list[list], needed: list[int]) -> list[list[list]]:
    """For each notice: its own words against every notice of another label that shares as many words as it needs."""
    holders: dict[object, list[int]] = {}
    for k, words in enumerate(sets):
        for w in words:
            holders.setdefault(w, []).append(k)
    out: list[list[list]] = []
    for k, words in enumerate(sets):
        shared: dict[int, int] = {}
        for w in words:
            for other in holders[w]:
                shared[other] = shared.get(other, 0) + 1
        own = [[w for w in words if w not in set(sets[o])] for o, n in sorted(shared.items()) if labels[o] != labels[k] and n >= needed[k]]
        out.append([w for w in own if w])
    return out


def _scan(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered = Chunk(chunk.first, chunk.rows, LOWER[chunk.buf], chunk.starts, chunk.ends)
    first, last, row = words(lowered, ALNUM)
    return first, row, span_hash(prefix_hash(lowered.buf), first, last)


def corpus_counts(documents: DataFrame, index: Index) -> dict[int, int]:
    """How often each notice word stands in the whole corpus: one row a word reaches the driver, as many as the notices have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.order) + 1, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                total += np.bincount(index.find(_scan(chunk)[2]) + 1, minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(index.order)), pa.int32()), "n": pa.array(total[1:], pa.int64())})

    rows = documents.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _windows(index: Index, k: int, at: np.ndarray, numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with windows that match notice ``k``, and their containment; words of any notice by place, number and text."""
    notice, needed, span = index.notices[k], index.needed[k], index.spans[k]
    word, ranks = index.by_word[k]
    found = np.minimum(np.searchsorted(word, numbers), len(word) - 1)
    mine = word[found] == numbers
    at, text, rank = at[mine], text[mine], ranks[found[mine]]
    # Windows may begin with a notice word; those near enough before a prefix word are candidates.
    prefix = np.flatnonzero(rank <= len(notice) - needed)
    low = np.searchsorted(at, at[prefix] - span + 1)
    step = np.zeros(len(at) + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, prefix + 1, -1)
    start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    stop = np.minimum(np.searchsorted(at, at[start] + span), np.searchsorted(text, text[start], side="right"))
    long = stop - start >= needed
    start, stop = start[long], stop[long]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0)
    size = stop - start
    window = np.repeat(np.arange(len(start)), size)
    held = np.unique(window * len(notice) + rank[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(window))])
    window, rank = held // len(notice), held % len(notice)
    lowest, overlap = rank[np.searchsorted(window, np.arange(len(start)))], np.bincount(window, minlength=len(start))
    ok = (len(notice) - lowest >= needed) & (overlap >= needed)
    for own in index.apart[k]:
        mine = np.zeros(len(start), bool)
        mine[window[np.isin(rank, ranks[np.searchsorted(word, own)])]] = True
        ok &= mine
    return text[start[ok]], overlap[ok] / len(notice)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _matches(index: Index, numbers: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[list[set[str]], np.ndarray]:
    """Labels and the best containment of each text; a notice is tried only around places where enough of its lengthened prefix stands."""
    labels: list[set[str]] = [set() for _ in range(n_rows)]
    best = np.zeros(n_rows)
    at = np.flatnonzero(numbers >= 0)
    number, text = numbers[at], row[at]
    deep, spans = np.array([index.deep(k) for k in range(len(index.notices))], np.int64), np.array(index.spans, np.int64)
    for begin, notices in index.prefixes:
        size = begin[number + 1] - begin[number]
        notice, word = notices[_spread(begin[number], size)], np.repeat(np.arange(len(at)), size)
        by = np.argsort(notice, kind="stable")
        notice, word = notice[by], word[by]
        # The hit with which a window that begins with this one holds enough of them.
        last = np.arange(len(notice)) + deep[notice] - 1
        inside = np.flatnonzero(last < len(notice))
        last = last[inside]
        near = (notice[last] == notice[inside]) & (text[word[last]] == text[word[inside]]) & (at[word[last]] - at[word[inside]] < spans[notice[inside]])
        inside, last = inside[near], last[near]
        if not len(inside):
            continue
        tried, first = np.unique(notice[inside], return_index=True)
        for k, a, b in zip(tried.tolist(), first.tolist(), [*first[1:].tolist(), len(inside)], strict=True):
            # All windows around these hits, as ranges of notice words.
            low = np.searchsorted(at, at[word[last[a:b]]] - spans[k] + 1)
            high = np.searchsorted(at, at[word[inside[a:b]]] + spans[k])
            # Both ends ascend with the hits, so each range adds what lies beyond the one before.
            low = np.maximum(low, np.concatenate([[0], high[:-1]]))
            around = _spread(low, np.maximum(high - low, 0))
            texts, share = _windows(index, k, at[around], number[around], text[around])
            np.maximum.at(best, texts, share)
            for r in np.unique(texts).tolist():
                labels[r].add(index.labels[k])
    return labels, best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(documents: DataFrame, notices: list[tuple[str, str]] | DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its license phrases and the notices that its windows match.

    ``notices`` are labels and texts, as a list or as a table (label, text) of up to ``MAX_NOTICES`` rows;
    those without words match nothing.

    ``score`` is 1 with a base phrase, else the largest containment that met the threshold, else 0.
    Null and empty texts have no words and no label (an empty string); repeated rows stay; an empty
    table gives an empty result; columns besides ``doc_id`` and ``text`` are not read.
    """
    if isinstance(notices, DataFrame):
        rows = notices.select("label", "text").where("label is not null and text is not null").limit(MAX_NOTICES + 1).collect()
        if len(rows) > MAX_NOTICES:
            raise ValueError(f"more than {MAX_NOTICES} notices")
        notices = [(r[0], r[1]) for r in rows]
    notices = [(label, text) for label, text in (NOTICES if notices is None else notices) if WORD.search(text.lower().encode())]
    index = Index.build(notices or NOTICES[:1], threshold)
    if not notices:
        index.labels, index.notices, index.needed, index.spans = [], [], [], []
    index = index.rank_by(corpus_counts(documents, index))
    phrases = [(word_hashes(p.encode().split()), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, row, hashes = _scan(chunk)
                n = chunk.rows
                count = np.bincount(row, minlength=n)
                begin = np.cumsum(count) - count
                places, of_label = [], [set() for _ in range(n)]
                for parts, label in phrases:
                    k = len(parts)
                    if len(hashes) < k:
                        continue
                    ok = row[k - 1 :] == row[: len(row) - k + 1]
                    for j, h in enumerate(parts):
                        ok &= hashes[j : len(hashes) - k + 1 + j] == h
                    found = np.flatnonzero(ok)
                    places.append(found)
                    for r in np.unique(row[found]).tolist():
                        of_label[r].add(label)
                at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
                n_base = np.bincount(row[at], minlength=n)
                upto = np.cumsum(n_base)
                some = n_base > 0
                lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
                lo[some] = at[(upto - n_base)[some]] - begin[some]
                hi[some] = at[upto[some] - 1] - begin[some]
                numbers = index.find(hashes)
                more, best = _matches(index, numbers, row, n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(chunk.first, n),
                        "n_words": pa.array(count, pa.int64()),
                        "n_base": pa.array(n_base, pa.int64()),
                        "first_word": pa.array(lo, pa.int64(), mask=~some),
                        "last_word": pa.array(hi, pa.int64(), mask=~some),
                        "base_labels": pa.array([",".join(sorted(x)) for x in of_label], pa.string()),
                        "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(of_label, more, strict=True)], pa.string()),
                        "score": pa.array(np.where(some, 1.0, best)),
                    }
                )

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
