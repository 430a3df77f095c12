"""A training corpus in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgrid.functions.tables import dropped, temporaries, written
from inkgrid.llm import mixing, near_dup, packing, pii, toxicity
from inkgrid.llm.shared import bounded_batches


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    bounded_batches(spark)
    return toxicity.remove_toxic(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    bounded_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts."""
    bounded_batches(spark)
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as the target weights of their domains ask; none is lost."""
    bounded_batches(spark)
    return mixing.mixed(docs, _labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", sanitise), ("mixing", mix), ("packing", pack)]

#: Trained scores and tokenizer ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. A stage's own tables go once its result is written, and that result once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with temporaries(spark):
            made = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if i:
            dropped(docs)
        docs = made
    return docs
