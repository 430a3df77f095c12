"""Per-image statistics: blur score, histogram threshold, local contrast."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.pictures import layout, map_pictures, plane, reflected
from inkgrid.functions.scalar import rint2
from inkgrid.operators.neighborhood import laplacian, laplacian_plane


def blur_score(pixels: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Population variance of the Laplacian from exact integer sums; blurry strictly below the threshold, on the raw score."""
    sums = laplacian(pixels).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("g").cast("long")).alias("s"), F.sum((F.col("g") * F.col("g")).cast("long")).alias("q"))
    raw = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double") / (F.col("n") * F.col("n")).cast("double")
    return sums.select("image_id", rint2(raw).alias("blur_score"), (raw < threshold).alias("is_blurry"))


def otsu_threshold(pixels: DataFrame) -> DataFrame:
    """Threshold of the largest between-class variance, the lowest among equals; 0 for a constant image."""
    bins = pixels.groupBy("image_id", "v").agg(F.count("*").alias("c"))
    image = Window.partitionBy("image_id")
    upto = image.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select("image_id", "v", F.sum("c").over(upto).alias("n1"), F.sum(F.col("c") * F.col("v")).over(upto).alias("s1"), F.sum("c").over(image).alias("n"), F.sum(F.col("c") * F.col("v")).over(image).alias("s"))
    d = (F.col("s1") * F.col("n") - F.col("n1") * F.col("s")).cast("double")
    sigma = d * d / (F.col("n1") * (F.col("n") - F.col("n1"))).cast("double")
    split = F.when(F.col("n1") < F.col("n"), F.struct(sigma.alias("sigma"), (-F.col("v")).alias("v")))
    return sums.groupBy("image_id").agg(F.coalesce(-F.max(split)["v"], F.lit(0)).alias("t"))


def threshold_of(counts: np.ndarray) -> int:
    """``otsu_threshold`` of a histogram of values from 0 on; whole numbers of any size."""
    values = np.flatnonzero(counts)
    n1, s1 = (np.cumsum(a.astype(object)) for a in (counts[values], counts[values].astype(object) * values))
    splits = [(float(a * n1[-1] - b * s1[-1]) ** 2 / float(b * (n1[-1] - b)), -int(v)) for v, a, b in zip(values[:-1], s1, n1, strict=False)]
    return -max(splits)[1] if splits else 0


def thresholds(v: np.ndarray) -> np.ndarray:
    """``otsu_threshold`` of each picture of a stack."""
    n, top = v[0].size, int(v.max(initial=0)) + 1
    counts = np.bincount((np.arange(len(v))[:, None] * top + v.reshape(len(v), -1)).ravel(), minlength=len(v) * top).reshape(-1, top)
    if n * n * top >= 1 << 62:  # sums beyond whole numbers of 64 bits
        return np.array([threshold_of(c) for c in counts])
    n1, s1 = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(top), axis=1)
    d, split = (s1 * n - n1 * s1[:, -1:]).astype(float), (counts > 0) & (n1 < n)
    sigma = np.where(split, d * d / np.maximum(n1 * (n - n1), 1).astype(float), -1.0)
    return np.where(split.any(1), np.argmax(sigma, axis=1), 0)


def sharpness_each(v: np.ndarray, threshold: float) -> list[tuple[float, bool]]:
    """``blur_score`` of each picture of a stack."""
    g = laplacian_plane(v.astype(np.int64))
    return [sharpness_of(g[0].size, int(s), int(q), threshold) for s, q in zip(g.sum((1, 2)), (g * g).sum((1, 2)), strict=True)]


def sharpness(v: np.ndarray, threshold: float) -> tuple[float, bool]:
    """``blur_score`` of a whole picture."""
    g = laplacian_plane(v.astype(np.int64))
    return sharpness_of(g.size, int(g.sum()), int((g * g).sum()), threshold)


def sharpness_of(n: int, total: int, squares: int, threshold: float) -> tuple[float, bool]:
    raw = float(n * squares - total * total) / float(n * n)
    return float(np.rint(raw * 100) / 100), raw < threshold


def extents(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def _tables(v: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Look-up tables of a picture's tiles, or of each picture's of a stack: one row of 256 for each tile, row by row.

    The picture is padded to whole tiles by reflection. Bins above the clip limit give their excess
    to all bins alike, and what is left to every ``s``-th bin.
    """
    height, width = (-(-n // tiles) for n in v.shape[-2:])
    down, across = np.arange(height * tiles), np.arange(width * tiles)
    padded = v[..., reflected(down, v.shape[-2])[:, None], reflected(across, v.shape[-1])]
    tile = (down // height)[:, None] * tiles + (across // width)[None, :] + _first_tiles(v, tiles)
    n = v.shape[0] if v.ndim == 3 else 1
    return tables_of(np.bincount((tile * 256 + padded).ravel(), minlength=n * tiles * tiles * 256).reshape(-1, 256), clip, height * width)


def tables_of_stack(v: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Tables of each picture of a stack: by picture, tile and value."""
    return _tables(v, clip, tiles).reshape(len(v), tiles * tiles, 256)


def _first_tiles(v: np.ndarray, tiles: int) -> np.ndarray | int:
    """The number of each picture's first tile in a stack."""
    return np.arange(len(v))[:, None, None] * tiles * tiles if v.ndim == 3 else 0


#: Bins that get one of ``left`` values each, by ``left``.
_SPREAD = np.array([[left > 0 and v % max(256 // max(left, 1), 1) == 0 and v // max(256 // max(left, 1), 1) < left for v in range(256)] for left in range(256)], np.uint8)
#: Pixels of a tile up to which every possible table value is computed once.
LISTED = 1 << 16


@lru_cache(maxsize=256)
def _levels(area: int) -> np.ndarray:
    return np.minimum(255, np.rint(np.arange(area + 1) * 255 / area)).astype(np.uint8)


def tables_of(counts: np.ndarray, clip: float, area: int) -> np.ndarray:
    """Tables from the histograms of tiles of ``area`` pixels, in bytes."""
    limit = max(1, int(clip * area / 256))
    level = np.minimum(counts, limit)
    excess = counts.sum(1) - level.sum(1)
    level += (excess // 256)[:, None]
    level += _SPREAD[excess % 256]
    upto = np.cumsum(level, axis=1)
    return _levels(area)[upto] if area <= LISTED else np.minimum(255, np.rint(upto * 255 / area)).astype(np.uint8)


def clahe_lut(pixels: DataFrame, clip: float = 1.5, tiles: int = 8) -> DataFrame:
    """Look-up table of every tile: image_id, ty, tx, v, lut."""

    def run(table: pa.Table) -> pa.Table:
        lut = _tables(plane(table, "v", *layout(table)), clip, tiles)
        tile, v = np.divmod(np.arange(lut.size, dtype=np.int32), np.int32(256))
        return pa.table({"image_id": pa.repeat(table["image_id"][0], lut.size), "ty": tile // np.int32(tiles), "tx": tile % np.int32(tiles), "v": v, "lut": lut.ravel().astype(np.int32)})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.groupBy("image_id").applyInArrow(run, f"image_id {kind}, ty int, tx int, v int, lut int")


def clahe_apply(pixels: DataFrame, clip: float = 1.5, tiles: int = 8) -> DataFrame:
    """Every pixel through the tables of its four nearest tiles, mixed by distance."""
    return map_pictures(pixels, lambda v: contrast_plane(v, clip, tiles))


def contrast_plane(v: np.ndarray, clip: float = 1.5, tiles: int = 8) -> np.ndarray:
    return mixed_tables(v, _tables(v, clip, tiles), v.shape[-2:], tiles)


def mixed_tables(v: np.ndarray, lut: np.ndarray, shape: tuple[int, int], tiles: int, first: int = 0) -> np.ndarray:
    """Scanlines ``first`` and on of a picture of ``shape`` through the tables of its tiles."""

    def axis(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.arange(low, high) / -(-n // tiles) - 0.5
        low = np.floor(f).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), f - low

    (y1, y2, fy), (x1, x2, fx) = axis(shape[0], first, first + v.shape[-2]), axis(shape[1], 0, shape[1])
    begin, flat = _first_tiles(v, tiles), lut.reshape(-1).astype(np.int32, copy=False)
    at = lambda y, x: flat[(begin + y[:, None] * tiles + x) * 256 + v]
    line = lambda y: at(y, x1) * (1 - fx) + at(y, x2) * fx
    return np.rint(line(y1) * (1 - fy)[:, None] + line(y2) * fy[:, None])
