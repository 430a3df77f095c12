"""The index is asked some segments at a time."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkgrid.llm import decontamination


def test_few_segments_a_batch(spark, monkeypatch):
    """No batch holds all segments of a task; the session's bound stays as it was."""
    seen, init = [], decontamination.materialise
    monkeypatch.setattr(decontamination, "materialise", lambda df, name, **o: (seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), init(df, name, **o))[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", text)], "item_id string, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(docs, bench).collect()}
    assert found == {1: 30, 2: 0}
    assert dict(seen)["matches"] == str(decontamination.SEGMENTS) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_index_is_read_in_small_parts(spark):
    """However many segments a task writes, a row group, which a reader unpacks at once, holds some megabytes of them."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: F.hash(x, "doc_id").cast("string")), " ")
    docs = spark.range(12).coalesce(1).withColumnRenamed("id", "doc_id").select("doc_id", words.alias("text"))
    index = decontamination.build_index(docs)
    groups = [g.total_byte_size for f in index.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(groups) > 3 * decontamination.ROW_GROUP and max(groups) < 2 * decontamination.ROW_GROUP
    assert index.selectExpr("explode(doc_ids) as d").distinct().count() == 12
