"""Rasters and recognition output derived from the given tables, every row of them, and PNG files to scan."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions.pictures import PICTURE, row_of, unpacked
from inkgrid.functions.tables import by_image

KEY = ("image_id", "y", "x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pictures(rows: DataFrame, draw: Callable[[pa.RecordBatch], Iterable[np.ndarray]], each: int = 1000) -> DataFrame:
    """Picture rows that ``draw`` makes of table rows, ``each`` at a time, whose first column is the image's id. The table rows are dealt out, as a small file may be one task of many pictures; pixels are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, each):
                part = batch.slice(low, each)
                drawn = [row_of(a) for a in draw(part)]
                columns = [pa.array([d[n] for d in drawn], t) for n, t in (("height", pa.int32()), ("width", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["image_id", "height", "width", "n_channels", "data"])

    return by_image(rows).mapInArrow(run, f"image_id {rows.dtypes[0][1]}, {PICTURE}")


def _characters(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Ids, and code points, 32 a scanline, the last one filled up with 0."""
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        cp = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
        yield key, np.pad(cp, (0, -len(cp) % 32)).reshape(-1, 32)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null and length(text) > 0").select(F.col("doc_id").alias("image_id"), "text")


def glyph_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as gray pictures, 32 characters a scanline."""
    return _pictures(_texts(spark, sf_dir), lambda batch: (126 + cp % 4 if k is not None and k % 3 == 0 else cp % 256 for k, cp in _characters(batch)))


def glyph_bgr_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    def colours(cp: np.ndarray) -> np.ndarray:
        return np.stack([cp * 5 % 256, (cp * 7 + np.arange(32)) % 256, (cp * 11 + np.arange(len(cp))[:, None]) % 256], axis=-1)

    return _pictures(_texts(spark, sf_dir), lambda batch: (colours(cp) for _, cp in _characters(batch)))


def glyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel rows of whole texts."""
    return unpacked(glyph_pictures(spark, sf_dir)).select(*KEY, F.col("b").alias("v"))


def glyph_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(glyph_bgr_pictures(spark, sf_dir))


def card_pictures(spark: SparkSession, sf_dir: str, source: str = "part") -> DataFrame:
    """A card on wood, 32 by 24, for every part (or supplier)."""
    key, size = {"part": ("p_partkey", "p_size"), "supplier": ("s_suppkey", "s_nationkey")}[source]
    rows = table(spark, sf_dir, source).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("image_id"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("size"))
    y, x = np.mgrid[0:24, 0:32]
    tones = np.array([(60, 110, 150), (230, 232, 235), (40, 40, 40)], np.uint8)  # wood, card, ink

    def draw(batch: pa.RecordBatch) -> np.ndarray:
        k, size = (batch.column(i).to_numpy().astype(np.int64)[:, None, None] for i in (0, 1))
        rest = lambda n: np.fmod(k, n)
        box = lambda a, b, w, h: (x >= a) & (x < a + w) & (y >= b) & (y < b + h)
        whole = box(3 + rest(5), 3 + rest(4), 10 + np.fmod(size, 13), 7 + np.fmod(size, 9))
        card = np.where(rest(11) == 0, False, np.where(rest(13) == 0, box(5, 5, 3, 3), whole))
        ink = card & (np.fmod(x + 3 * y + k, 7) == 0) & (rest(13) != 0)
        decoy = ~card & (rest(4) == 0) & box(27, 20, 4, 4)
        return tones[np.where(ink, 2, np.where(card | decoy, 1, 0))]

    return _pictures(rows, draw)


def card_bgr(spark: SparkSession, sf_dir: str, source: str = "part") -> DataFrame:
    """Pixel rows of cards."""
    return unpacked(card_pictures(spark, sf_dir, source))


def ruling_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted rules, 96 by 72, for every supplier: slope of -20 to 20 per cent."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey is not null").select(F.col("s_suppkey").cast("long").alias("image_id"))
    y, x = np.mgrid[0:72, 0:96]

    def draw(batch: pa.RecordBatch) -> np.ndarray:
        slope = np.fmod(batch.column(0).to_numpy(), 41)[:, None, None] - 20
        return np.where((100 * y - x * slope) % 1600 < 200, np.uint8(0), np.uint8(255))

    return _pictures(rows, draw, 200)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rasters of eight columns."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int")
    return by_image(rows.select("image_id", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v")))


def raw_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition output of every document in two variants: its lines as texts, a score from a digest, a box a line."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    k = F.col("doc_id")
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines")).withColumn("variant", F.explode(F.array(F.lit("raw"), F.lit("preprocessed"))))
    rows = rows.withColumn("lines", F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("lines")))
    score = F.transform("lines", lambda t: (F.conv(F.substring(F.md5(F.concat("variant", t)), 1, 6), 16, 10).cast("long") % 1000) / F.lit(1000.0))
    poly = lambda t, i: F.array(*[F.array(x, y) for x, y in ((F.lit(4.0), 16 * i + 2.75), (4.0 + 8 * F.length(t), 16 * i + 2.75), (4.0 + 8 * F.length(t), 16 * i + 14.5), (F.lit(4.0), 16 * i + 14.5))])
    polys = F.transform("lines", poly)
    polys = F.when(k % 7 == 0, F.slice(polys, F.lit(1), F.greatest(F.size(polys) - 1, F.lit(0)))).otherwise(polys)
    pages = F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.concat(F.lit("scan/"), "doc_id", F.lit(".png")).alias("document_name"), "variant", F.explode(pages).alias("page"), F.col("lines").alias("rec_texts"), F.when(k % 13 != 0, score).alias("rec_scores"), polys.alias("dt_polys"))


def _png(width: int, height: int, bgr: bytes) -> bytes:
    rows = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)[:, :, ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def write_png(images: DataFrame, path: str, per_folder: int | None = None) -> None:
    """One RGB PNG file an image, named by its id, written by the executors to a folder in any file system that Arrow knows (file, hdfs, s3, gs).

    With ``per_folder`` they go to folders inside it, of so many files at most, as ``scan_folders`` reads them.
    """

    def write(rows: Iterator[Row]) -> None:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        into = folder
        for n, r in enumerate(rows):
            if per_folder and n % per_folder == 0:
                into = f"{folder}/{TaskContext.get().partitionId()}-{n // per_folder}"
                system.create_dir(into)
            with system.open_output_stream(f"{into}/{r['image_id']}.png") as out:
                out.write(_png(r["width"], r["height"], bytes(r["data"])))

    images.select("image_id", "width", "height", "data").foreachPartition(write)
