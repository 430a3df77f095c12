"""Batch recognition with a recogniser that the caller supplies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from inkgrid import schemas

Recogniser = Callable[[pd.DataFrame], pd.DataFrame]
#: Of this worker process: recognisers by the digest of their factory, the one used last at the end.
_BUILT: dict[str, Recogniser] = {}
#: Recognisers that a worker keeps.
KEPT = 4


def _recogniser(key: str, factory: bytes) -> Recogniser:
    found = _BUILT.pop(key, None) or cloudpickle.loads(factory)()
    _BUILT[key] = found
    while len(_BUILT) > KEPT:
        del _BUILT[next(iter(_BUILT))]
    return found


def _recognised(key: str, factory: bytes, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Workers reach this function by import, so ``_BUILT`` is the worker's own and outlives the task."""
    for batch in batches:
        yield _recogniser(key, factory)(batch)


def _tolerated(key: str, factory: bytes, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch that fails is tried image by image; an image that fails is told by a row of its own."""
    for batch in batches:
        try:
            yield _recogniser(key, factory)(batch).assign(failure=None)
        except Exception:
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1].reset_index(drop=True)
                try:
                    yield _recogniser(key, factory)(one).assign(failure=None)
                except Exception as e:
                    yield pd.DataFrame({**dict.fromkeys(_COLUMNS), "document_name": one["path"], "failure": f"{type(e).__name__}: {e}"})


_COLUMNS = [c.split()[0] for c in schemas.RAW_OCR.split(", ")]


def recognize_batch(images: DataFrame, factory: Callable[[], Recogniser], tolerant: bool = False) -> DataFrame:
    """Recognition output of a table of images.

    ``factory`` builds the recogniser, which maps image rows to rows of the raw schema, once in the
    life of a Python worker, however many tasks the worker runs. Factories are told apart by what they pickle
    to, not by their names; a worker keeps the last ``KEPT`` recognisers. A task without images builds none.
    With ``tolerant`` an image that the recogniser cannot do gives a row of nulls with its name and the message in a
    column ``failure``, null for the others.
    """
    pickled = cloudpickle.dumps(factory)
    run = partial(_tolerated if tolerant else _recognised, hashlib.sha256(pickled).hexdigest(), pickled)
    return images.mapInPandas(run, schemas.RAW_OCR + ", failure string" * tolerant)
