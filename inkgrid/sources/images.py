"""Images in and out as tables."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkgrid import schemas
from inkgrid.functions.pictures import RETURNED, packed, unpacked
from inkgrid.functions.tables import shared_folder


def scan_images(spark: SparkSession, paths: str | list[str], on_invalid: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Images as rows of BGR bytes. An unreadable file raises when its row is read (``fail``), goes (``drop``), or comes back in a second table (``quarantine``)."""
    found = spark.read.format("image").load(paths).select("image.*")
    row = [F.col("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data"]
    if on_invalid == "fail":
        message = F.concat(F.lit("Unable to load image: "), F.col("origin"))
        return found.withColumn("height", F.when(F.col("height") < 0, F.raise_error(message).cast("int")).otherwise(F.col("height"))).select(*row)
    good = found.where("height >= 0").select(*row)
    return (good, found.where("height < 0").select(F.col("origin").alias("path"))) if on_invalid == "quarantine" else good


#: What opening a file counts for when small files are put into tasks: some 500 files a task.
OPEN_COST = 1 << 18


#: Bytes of a file up to which it is decoded as a small one, if it is a plain PNG.
SMALL_FILE = 1 << 16
_PNG = b"\x89PNG\r\n\x1a\n"


def plain_png(data: bytes) -> tuple[int, int, bytes] | None:
    """Height, width and BGR bytes of a sound PNG of nothing but an eight-bit RGB picture, its scanlines without the last two filters; None for all else."""
    if not data.startswith(_PNG):
        return None
    at, names, parts, size = len(_PNG), [], [], None
    while at < len(data):
        if at + 12 > len(data):
            return None
        length, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if at + 12 + length > len(data) or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            return None
        if name == b"IHDR" and not names and length == 13 and body[8:] == bytes((8, 2, 0, 0, 0)):
            size = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            parts.append(body)
        elif name != b"IEND" or at + 12 + length != len(data):
            return None
        names.append(name)
        at += 12 + length
    if size is None or names != [b"IHDR", *[b"IDAT"] * len(parts), b"IEND"] or not parts:
        return None
    width, height = size
    n = height * (3 * width + 1)
    if not 0 < 3 * width * height <= RETURNED:
        return None
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(parts), n + 1)
    except zlib.error:
        return None
    if len(raw) != n or not stream.eof or stream.unused_data:
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(height, 3 * width + 1)
    kinds, rgb = lines[:, 0], lines[:, 1:].reshape(height, width, 3)
    if kinds.max() > 2:
        return None
    if kinds.any():
        rgb = rgb.copy()
        for y in np.flatnonzero(kinds).tolist():
            if kinds[y] == 1:
                rgb[y] = np.cumsum(rgb[y], axis=0, dtype=np.uint8)
            elif y:
                rgb[y] += rgb[y - 1]
    return height, width, rgb[..., ::-1].tobytes()


def _small_pictures(files: DataFrame) -> DataFrame:
    """Picture rows of files that are small plain PNGs; the others have nulls instead."""
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def rows(paths: list[str], found: list[tuple[int, int, bytes] | None]) -> pa.RecordBatch:
        every = [(None,) * 4 if f is None else (f[0], f[1], 3, f[2]) for f in found]
        columns = [pa.array(c, k) for c, k in zip(zip(*every, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string())] * 2 + columns, ["image_id", "path", "height", "width", "n_channels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found, held = [], [], 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                paths.append(path)
                found.append(plain_png(content.as_py()) if content.is_valid else None)
                held += len(found[-1][2]) if found[-1] else 0
                if held >= RETURNED:
                    yield rows(paths, found)
                    paths, found, held = [], [], 0
            if paths:
                yield rows(paths, found)

    # Where the image source says that a picture comes from.
    read = files.select(F.input_file_name().alias("path"), F.when(F.col("length") <= SMALL_FILE, F.col("content")).alias("content"))
    return read.mapInArrow(run, "image_id string, path string, height int, width int, n_channels int, data binary")


def scan_folders(spark: SparkSession, path: str, at_once: int = 100) -> DataFrame:
    """``scan_images`` of very many small files in the folders inside ``path``, as a written table of picture rows.

    ``at_once`` folders are listed (by Spark, in tasks) and read at a time, so the driver never holds a list of all files, and
    a task reads hundreds of files, not the 32 that Spark's cost of opening a file allows. Spark's image source takes some
    four milliseconds a file, most of them to set up its encoder anew; so small plain PNGs are read as bytes and decoded in
    Arrow batches, and the image source reads what is left, the unreadable ones among it.
    """
    system, root = fs.FileSystem.from_uri(path)
    folders = sorted(f"{path.rstrip('/')}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)
    if not folders:
        return scan_images(spark, path)
    out, cost = f"{shared_folder(spark)}/scanned-{uuid.uuid4().hex}", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, str(OPEN_COST))
    try:
        for low in range(0, len(folders), at_once):
            small = _small_pictures(spark.read.format("binaryFile").load(folders[low : low + at_once]))
            small.write.mode("append").parquet(f"{out}/small")
        every = spark.read.schema(small.schema).parquet(f"{out}/small")
        found, left = every.where("height is not null"), every.where("height is null").select("path")
        # A folder is named by its last part, as a path's other parts may be written in other ways.
        named = {unquote(r[0]) for r in left.select(F.element_at(F.split("path", "/"), -2)).distinct().collect()}
        rest = [f for f in folders if f.rsplit("/", 1)[1] in named]
        for low in range(0, len(rest), at_once):
            other = scan_images(spark, rest[low : low + at_once]).join(left, "path", "left_semi").select(found.columns)
            other.write.mode("append").parquet(f"{out}/other")
    finally:
        spark.conf.set(cost, before)
    other = spark.read.schema(found.schema).parquet(f"{out}/other") if rest else found.limit(0)
    if named and other.count() != left.count():
        raise RuntimeError("the image source names some files in another way than the scan of small ones")
    return found.unionByName(other) if rest else found


def readable() -> Column:
    """Whether an image row holds a picture: positive sizes, 1, 3 or 4 channels, and as many bytes as they need."""
    h, w, c = (F.coalesce(n, F.lit(-1)).cast("long") for n in ("height", "width", "n_channels"))
    return F.coalesce((h > 0) & (w > 0) & c.isin(1, 3, 4) & (F.length("data") == h * w * c), F.lit(False))


def readable_images(images: DataFrame, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Image rows that hold a picture and, with ``quarantine``, the others as failures (image_id, stage, message).

    With ``fail`` the first other row that is read raises; with ``drop`` the others go.
    """
    what = F.concat(F.lit("Unable to load image: "), F.coalesce(F.col("image_id").cast("string"), F.lit("null")))
    if on_invalid == "fail":
        return images.withColumn("data", F.when(readable(), F.col("data")).otherwise(F.raise_error(what).cast("binary"))), None
    failures = images.where(~readable()).select("image_id", F.lit("scan").alias("stage"), what.alias("message"))
    return images.where(readable()), failures if on_invalid == "quarantine" else None


def raster_to_pixels(images: DataFrame) -> DataFrame:
    """One row per pixel; the bytes are split in Arrow batches. Gray images give equal channels."""
    return unpacked(images)


def pack_raster(bgr: DataFrame) -> DataFrame:
    """Pixels back to one row of bytes an image, in row-major order."""
    return packed(bgr)


def save_rasters(images: DataFrame, path: str, partition: str | None = None) -> None:
    writer = images.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_raw_ocr(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Recognition output with its fixed schema, from Parquet or JSON."""
    return spark.read.schema(schemas.RAW_OCR).format(kind).load(path)


def write_ocr_json(documents: DataFrame, path: str) -> None:
    """One JSON record a document, UTF-8, non-ASCII as it is."""
    documents.write.mode("overwrite").json(path)


def pretty_json(documents: DataFrame) -> DataFrame:
    """Each record as one indented JSON text."""
    return documents.select("document_name", F.to_json(F.struct("document_name", "total_blocks", "results"), {"pretty": "true"}).alias("json"))


def read_ocr_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
