"""Recognition output: alignment, empties, pages, formats, and the image source."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inkgrid import fixtures, schemas
from inkgrid.operators import ocr, recognize
from inkgrid.sources import images
from inkgrid.streaming.blocks import stream_blocks

BOX = [[0.5, 20.75], [9.0, 20.75], [9.0, 30.0], [0.5, 30.0], [7.0, 7.0]]
ROWS = [
    ("a", "raw", 0, ["x", "é", "z"], [0.5, 0.25, 0.1], [BOX, BOX]),
    ("a", "raw", 1, ["page two"], [0.9], [BOX]),
    ("b", "raw", 0, [], [], []),
    ("c", "raw", 0, ["q"], None, [BOX]),
    ("a", "preprocessed", 0, ["x"], [0.75], [BOX]),
]


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(ROWS, schemas.RAW_OCR)


def test_blocks(raw):
    rows = ocr.ocr_blocks(raw).where("variant = 'raw'").orderBy("document_name", "block_idx").collect()
    assert [(r["document_name"], r["block_idx"], r["text"]) for r in rows] == [("a", 0, "x"), ("a", 1, "é")]
    assert rows[0]["bbox"]["bottom_left"] == [0.5, 30.0]
    assert ocr.ocr_blocks(raw, page=None).count() == 4


def test_short_polygon_fails(spark):
    bad = spark.createDataFrame([("a", "raw", 0, ["x"], [0.5], [BOX[:3]])], schemas.RAW_OCR)
    with pytest.raises(Exception, match="four points"):
        ocr.ocr_blocks(bad).collect()


def test_documents_and_summaries(raw):
    docs = {(r["document_name"], r["variant"]): r for r in ocr.ocr_documents(raw).collect()}
    assert {k: v["total_blocks"] for k, v in docs.items()} == {("a", "raw"): 2, ("b", "raw"): 0, ("c", "raw"): 0, ("a", "preprocessed"): 1}
    assert docs["b", "raw"]["results"] == [] and [x["text"] for x in docs["a", "raw"]["results"]] == ["x", "é"]
    assert sum(v["total_blocks"] for v in docs.values()) == ocr.ocr_blocks(raw).count()
    means = {(r[0], r[1]): r["mean_confidence"] for r in ocr.confidence_summary(raw).collect()}
    assert means["a", "raw"] == 0.375 and means["b", "raw"] is None
    side = {r["document_name"]: r for r in ocr.variant_comparison(raw).collect()}
    assert side["a"]["raw_blocks"] == 2 and side["a"]["preprocessed_confidence"] == 0.75 and side["b"]["preprocessed_blocks"] is None
    audit = {(r[0], r[1]): r["misaligned"] for r in ocr.alignment_audit(raw).collect()}
    assert audit == {("a", "raw"): True, ("b", "raw"): False, ("c", "raw"): True, ("a", "preprocessed"): False}


def test_listing_and_overlay(raw):
    lines = [r["line"] for r in ocr.block_listing(raw).where("variant = 'raw'").orderBy("number").collect()]
    assert lines == ['[1] "x"  (conf: 0.50)', '[2] "é"  (conf: 0.25)']
    o = ocr.overlay_annotations(raw).where("variant = 'preprocessed'").first()
    assert (o["x1"], o["y1"], o["label_y"], o["poly_bgr"], o["coord_space"]) == (0, 20, 15, "0,255,0", "original")


def test_json_roundtrip(spark, raw):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    docs = ocr.ocr_documents(raw)
    images.write_ocr_json(docs, path)
    text = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert "é" in text
    assert sorted(map(str, images.read_ocr_json(spark, path, docs.schema).collect())) == sorted(map(str, docs.collect()))
    assert "\n" in images.pretty_json(docs).first()["json"]


def test_image_source(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    px = spark.createDataFrame([(7, y, x, 10 * y, x, 200) for y in range(3) for x in range(4)], schemas.PIXELS_BGR)
    packed = images.pack_raster(px)
    fixtures.write_png(packed, path)
    open(f"{path}/junk.png", "wb").write(b"not an image")
    good, bad = images.scan_images(spark, path, "quarantine")
    assert good.count() == 1 and bad.count() == 1 and images.scan_images(spark, path, "drop").count() == 1
    row = good.first()
    assert (row["height"], row["width"], bytes(row["data"])) == (3, 4, bytes(packed.first()["data"]))
    with pytest.raises(Exception, match="Unable to load image"):
        images.scan_images(spark, path).collect()
    back = images.raster_to_pixels(packed).orderBy("y", "x").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in px.orderBy("y", "x").collect()]


def test_recognizer(spark):
    import pandas as pd

    table = spark.createDataFrame([("i", "p.png", 1, 2, 3, b"\1\2\3\4\5\6")], schemas.IMAGES)

    def factory():
        return lambda b: pd.DataFrame({"document_name": b["path"], "variant": "raw", "page": 0, "rec_texts": [["t"]] * len(b), "rec_scores": [[0.5]] * len(b), "dt_polys": [[BOX]] * len(b)})

    assert ocr.ocr_blocks(recognize.recognize_batch(table, factory)).first()["text"] == "t"


def test_stream(spark, raw):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw.write.mode("overwrite").parquet(path)
    query = stream_blocks(spark, path).select("text").writeStream.format("memory").queryName("blocks").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("blocks").count() == ocr.ocr_blocks(raw).count()


def test_quality_attach(raw, spark):
    quality = spark.createDataFrame([("a", 12.5, True, False)], schemas.QUALITY)
    got = {(r["document_name"], r["variant"]): r["is_blurry"] for r in ocr.with_quality(ocr.ocr_documents(raw), quality).collect()}
    assert got["a", "raw"] is True and got["b", "raw"] is None
    assert raw.select(F.count("*")).first()[0] == 5


def _counting(folder: str, answer: str):
    """A factory that leaves a line for each recogniser it builds; nested, so that it travels by value."""

    def factory():
        import os as system

        with open(f"{folder}/{system.getpid()}-{answer}", "a") as out:
            out.write("built\n")

        def run(batch):
            import pandas

            return pandas.DataFrame({"document_name": batch["path"], "variant": "raw", "page": 0, "rec_texts": [[answer]] * len(batch), "rec_scores": [[1.0]] * len(batch), "dt_polys": [[BOX]] * len(batch)})

        return run

    return factory


def test_one_recogniser_a_worker(spark):
    """Many tasks in a worker build one; two factories of one name build two; an empty table builds none."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    table = spark.createDataFrame([(str(i), f"p{i}", 1, 1, 1, bytearray(b"x")) for i in range(60)], schemas.IMAGES).repartition(12)
    one, two = _counting(folder, "one"), _counting(folder, "two")
    for factory, answer in ((one, "one"), (two, "two"), (one, "one")):
        assert {tuple(r["rec_texts"]) for r in recognize.recognize_batch(table, factory).collect()} == {(answer,)}
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            assert f.read() == "built\n", name
    assert {n.split("-")[1] for n in os.listdir(folder)} == {"one", "two"}
    assert recognize.recognize_batch(table.limit(0), _counting(folder, "none")).count() == 0 and not any("none" in n for n in os.listdir(folder))


def test_documents_in_one_scan(spark, raw):
    for df in (ocr.ocr_documents(raw), ocr.confidence_summary(raw)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
