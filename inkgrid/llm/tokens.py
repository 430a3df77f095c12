"""Token ids of whole texts by a published tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
BATCH_BYTES = 1 << 20
CACHE_PIECES = 800_000
LONGEST_CACHED = 48
#: A single space between two visible characters: byte-level BPE files of this family begin a new piece there.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space, where a plain split would not do.
UNSAFE = re.compile(r" (?:(?=\s)|(?<=\s\s))")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts; pieces that recur are encoded once and looked up afterwards.

    Texts are cut only where the tokenizer itself always cuts, so the ids are those of the whole text.
    Texts that hold one of its added tokens (such as an end marker) are not cut at all.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        if hasattr(self.tokenizer.model, "_resize_cache"):  # repeats are looked up here instead
            self.tokenizer.model._resize_cache(0)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Ids that begin with a space (the byte-level alphabet writes it as U+0120).
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _encode_spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space inside, each after one space, encoded some thousand at a time."""
        out: list[bytes] = []
        runs = ["".join(" " + p for p in pieces[i : i + 2000]) for i in range(0, len(pieces), 2000)]
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            data, size = ids.tobytes(), ids.itemsize
            at = (np.flatnonzero(self.spaced[ids]) * size).tolist() + [len(data)]
            out += [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if len(out) != len(pieces):
            raise ValueError("this tokenizer joins pieces across single spaces")
        return out

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # The pieces of a text; all but the first stand for themselves after one space.
        split = [[t] if self.added and self.added.search(t) else CUT.split(t) if UNSAFE.search(t) else t.split(" ") for t in texts]
        heads = self._encode([s[0] for s in split])
        pieces = [p for s in split for p in s[1:]]
        found = list(map(self.known.get, pieces))
        at = [i for i, x in enumerate(found) if x is None]
        missing = set(map(pieces.__getitem__, at))
        plain = [p for p in missing if p and p == p.strip() and " " not in p]
        other = list(missing.difference(plain))
        fresh = dict(zip(plain + other, self._encode_spaced(plain) + self._encode([" " + p for p in other]), strict=True))
        for i in at:
            found[i] = fresh[pieces[i]]
        if len(self.known) < CACHE_PIECES:  # the first pieces met are mostly the frequent ones
            self.known.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST_CACHED)
        out, first = [], 0
        for head, s in zip(heads, split, strict=True):
            last = first + len(s) - 1
            out.append(np.frombuffer(head + b"".join(found[first:last]), self.dtype))
            first = last
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids of documents with their end id, some texts at a time (columns ``doc_id`` and ``text``); null texts are empty."""
    code = encoder(path)
    end = np.array([END_ID], code.dtype)
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            base = sizes[row - 1] if row else 0
            stop = min(max(row + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, side="right"))), batch.num_rows)
            part = batch.slice(row, stop - row)
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield part.column("doc_id").to_pylist(), [np.concatenate([x, end]) for x in code.encode(texts)]
            row = stop
