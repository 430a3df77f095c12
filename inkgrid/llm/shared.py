"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from inkgrid.functions.tables import written


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a written table: its rows stay as they were written even if the plan above is not deterministic."""
    return written(df, name, **options)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch between Spark and Python, so that a batch of whole texts stays at some megabytes.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless it has a smaller bound already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside, where a row is some megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
