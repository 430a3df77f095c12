"""Recognition output as a stream: the row-wise operators need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgrid import schemas
from inkgrid.operators.ocr import ocr_blocks


def stream_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every file of recognition output that arrives in a folder."""
    return ocr_blocks(spark.readStream.schema(schemas.RAW_OCR).parquet(path))
