"""Per-pixel projections and predicates: no operator here shuffles, so all of them also take a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("image_id", "y", "x")
#: The wood tones that do not belong to a card, inclusive, as (h, s, v).
WOOD = ((5, 25, 40), (35, 200, 220))


def luma() -> Column:
    """Integer luma of blue, green and red."""
    return F.expr("cast((299 * r + 587 * g + 114 * b + 500) div 1000 as int)")


def luma_plane(bgr: np.ndarray) -> np.ndarray:
    """``luma`` of a whole picture, blue, green and red along the last axis."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    return (299 * r + 587 * g + 114 * b + 500) // 1000


def to_gray(bgr: DataFrame) -> DataFrame:
    return bgr.select(*KEY, luma().alias("v"))


def gray_to_bgr(pixels: DataFrame) -> DataFrame:
    return pixels.select(*KEY, F.col("v").alias("b"), F.col("v").alias("g"), F.col("v").alias("r"))


def hsv_columns() -> tuple[Column, Column, Column]:
    """Hue in half degrees, saturation and value, all 8-bit, from columns b, g, r."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (v - low).cast("double")
    s = F.when(v == 0, 0).otherwise(F.floor(255 * d / v + 0.5).cast("int"))
    h = F.when(v == low, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    h = F.when(h < 0, h + 360).otherwise(h)
    return F.pmod(F.floor(h / 2 + 0.5).cast("int"), F.lit(180)), s, v


def to_hsv(bgr: DataFrame) -> DataFrame:
    h, s, v = hsv_columns()
    return bgr.select(*KEY, h.alias("h"), s.alias("s"), v.alias("v"))


def in_range(low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """255 where h, s and v all lie within the bounds, ends included."""
    h, s, v = hsv_columns()
    return F.when(h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2]), 255).otherwise(0)


def in_range_plane(bgr: np.ndarray, low: tuple[int, int, int], high: tuple[int, int, int]) -> np.ndarray:
    """``in_range`` of a whole picture, as booleans."""
    b, g, r = (bgr[..., i].astype(np.int32) for i in range(3))
    v, least = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = (v - least).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(v == 0, 0, np.floor(255 * d / v + 0.5))
        h = np.select([v == least, v == r, v == g], [0.0, 60 * (g - b) / d, 120 + 60 * (b - r) / d], 240 + 60 * (r - g) / d)
    h = np.floor(np.where(h < 0, h + 360, h) / 2 + 0.5) % 180
    return np.logical_and.reduce([(low[i] <= x) & (x <= high[i]) for i, x in enumerate((h, s, v))])


def range_mask(bgr: DataFrame, low: tuple[int, int, int] = WOOD[0], high: tuple[int, int, int] = WOOD[1]) -> DataFrame:
    return bgr.select(*KEY, in_range(low, high).alias("v"))


def mask_not(column: Column) -> Column:
    return 255 - column


def mask_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def binarize(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """255 strictly above the image's threshold ``t``, else 0; one narrow row an image joins its pixels, which are never broadcast."""
    return pixels.hint("merge").join(thresholds.select("image_id", "t"), "image_id").select(*KEY, F.when(F.col("v") > F.col("t"), 255).otherwise(0).alias("v"))


def divide_by_background(v: Column, background: Column) -> Column:
    """``v * 255 / background``, half to even and saturating; 0 over a black background."""
    return F.when(background == 0, 0).otherwise(F.least(F.lit(255), F.rint(v * 255 / background).cast("int")))


def divided_plane(v: np.ndarray, background: np.ndarray) -> np.ndarray:
    """``divide_by_background`` of a whole picture."""
    return np.where(background == 0, 0, np.minimum(255, np.rint(v.astype(np.int64) * 255 / np.maximum(background, 1)))).astype(np.int32)


def cut_plane(picture: np.ndarray, box: tuple[int, int, int, int] | None, margin: int) -> np.ndarray:
    """``crop`` of a whole picture to its box (x, y, w, h)."""
    height, width = picture.shape[:2]
    if box is None:
        return picture
    x1, y1 = min(box[0] + margin, width - 1), min(box[1] + margin, height - 1)
    x2, y2 = min(box[0] + box[2] - margin, width), min(box[1] + box[3] - margin, height)
    return picture[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else picture


def crop(pixels: DataFrame, boxes: DataFrame, margin: int = 5) -> DataFrame:
    """Cut each image to its box moved inwards by ``margin``; without a box, or if nothing is left, the image stays whole.

    ``boxes`` has image_id, x, y, w, h, height and width, with a null ``x`` for images without a region.
    """
    x1, y1 = F.least(F.col("bx") + margin, F.col("width") - 1), F.least(F.col("by") + margin, F.col("height") - 1)
    x2, y2 = F.least(F.col("bx") + F.col("w") - margin, F.col("width")), F.least(F.col("by") + F.col("h") - margin, F.col("height"))
    fits = F.col("bx").isNotNull() & (x2 > x1) & (y2 > y1)
    edges = boxes.withColumnsRenamed({"x": "bx", "y": "by"}).select("image_id", *[F.when(fits, e).otherwise(F.lit(z)).alias(n) for e, z, n in ((x1, 0, "x1"), (y1, 0, "y1"), (x2, 2**30, "x2"), (y2, 2**30, "y2"))])
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    rest = [c for c in pixels.columns if c not in KEY]
    # Spark takes what Python makes of few rows for as few and would broadcast the pixels; dealt by image, they are not shuffled again.
    return pixels.hint("merge").join(edges, "image_id").where(inside).select("image_id", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), *rest)
