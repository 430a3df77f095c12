"""Rotation with a canvas that grows: geometry as a projection, resampling as a gather picture by picture."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.pictures import KEY, layout, plane, rows_of
from inkgrid.functions.scalar import cubic_weights

#: Fraction bits of the rotation's sine and cosine; all later arithmetic is in integers.
UNIT = 1 << 20


def rotation_geometry(skew: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rotation about the centre by the skew angle, and the grown canvas; images without a correction keep theirs."""
    angle = F.radians(F.when(F.col("applied"), F.col("median_angle")).otherwise(0.0))
    g = sizes.join(skew, "image_id").withColumn("c", F.round(F.cos(angle) * UNIT).cast("long")).withColumn("s", F.round(F.sin(angle) * UNIT).cast("long"))
    h, w, c, s = F.col("height"), F.col("width"), F.col("c"), F.col("s")
    g = g.withColumn("new_w", F.floor((h * F.abs(s) + w * F.abs(c)) / UNIT).cast("int")).withColumn("new_h", F.floor((h * F.abs(c) + w * F.abs(s)) / UNIT).cast("int"))
    cx, cy = F.floor(w / 2), F.floor(h / 2)
    m02 = ((UNIT - c) * cx - s * cy) / UNIT + (F.col("new_w") - w) / 2
    m12 = (s * cx + (UNIT - c) * cy) / UNIT + (F.col("new_h") - h) / 2
    return g.select("image_id", "height", "width", "new_w", "new_h", F.round(c / UNIT, 9).alias("m00"), F.round(s / UNIT, 9).alias("m01"), F.round(m02, 9).alias("m02"), F.round(-s / UNIT, 9).alias("m10"), F.round(c / UNIT, 9).alias("m11"), F.round(m12, 9).alias("m12"), "c", "s")


def canvas(height: int, width: int, angle: float | None) -> tuple[int, int, int, int]:
    """``rotation_geometry`` of one picture: cosine and sine in ``UNIT``, new height and width."""
    radians = math.radians(angle or 0.0)
    c, s = (math.floor(f(radians) * UNIT + 0.5) if f(radians) >= 0 else -math.floor(-f(radians) * UNIT + 0.5) for f in (math.cos, math.sin))
    return c, s, (height * abs(c) + width * abs(s)) // UNIT, (height * abs(s) + width * abs(c)) // UNIT


def turned_planes(sources: list[np.ndarray], c: int, s: int, nh: int, nw: int) -> list[np.ndarray]:
    """``rotate_gather`` of whole planes of one picture, 256 scanlines of the target at a time."""
    h, w = sources[0].shape
    out = [np.empty((nh, nw), np.int64) for _ in sources]
    for low in range(0, nh, 256):
        high = min(low + 256, nh)
        x, y = source_places(np.arange(low, high)[:, None], np.arange(nw)[None, :], h, w, c, s, nh, nw)
        for source, target in zip(sources, out, strict=True):
            target[low:high] = gathered(source, x, y, h, w)
    return out


def source_places(row: np.ndarray, column: np.ndarray, h: int, w: int, c: int, s: int, nh: int, nw: int) -> tuple[np.ndarray, np.ndarray]:
    """Where target places come from, in 32nds of a pixel."""
    cx, cy = w // 2, h // 2
    # Twice the offsets from the canvas centre, so that halves stay whole.
    dx, dy = 2 * column - (nw - w) - 2 * cx, 2 * row - (nh - h) - 2 * cy
    at = lambda a, centre: (16 * a + centre * 32 * UNIT + UNIT // 2) // UNIT
    return at(c * dx - s * dy, cx), at(s * dx + c * dy, cy)


def gathered(source: np.ndarray, x: np.ndarray, y: np.ndarray, h: int, w: int, top: int = 0, left: int = 0) -> np.ndarray:
    """Cubic interpolation at places in 32nds of a pixel; ``source`` holds what they need of a picture of ``h`` by ``w``, from ``top`` and ``left`` on."""
    weights = np.array(cubic_weights(), np.int64)
    wx, wy, x, y = weights[x % 32], weights[y % 32], x // 32, y // 32
    source, total = source.astype(np.int64), np.zeros(x.shape, np.int64)
    columns_at = [np.clip(x + i - 1, 0, w - 1) - left for i in range(4)]
    for j in range(4):
        row = np.clip(y + j - 1, 0, h - 1) - top
        total += wy[..., j] * sum(wx[..., i] * source[row, columns_at[i]] for i in range(4))
    return np.clip((total + (1 << 21)) >> 22, 0, 255)


def rotate_gather(pixels: DataFrame, geometry: DataFrame) -> DataFrame:
    """Every target pixel from sixteen source pixels, cubic weights at 32nds of a pixel, the border repeated; exact integers.

    All columns beside the place are turned, gray or colour. A picture and its row of geometry meet in
    one task; memory is one image, some scanlines of the target at a time.
    """
    columns = [c for c in pixels.columns if c not in KEY]

    def run(table: pa.Table, g: pa.Table) -> pa.Table:
        if not table.num_rows or not g.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in table.select([*KEY, *columns]).schema})
        place, h, w = layout(table)
        c, s, nw, nh = (g[n][0].as_py() for n in ("c", "s", "new_w", "new_h"))
        out = turned_planes([plane(table, n, place, h, w) for n in columns], c, s, nh, nw)
        return rows_of(table["image_id"][0], dict(zip(columns, out, strict=True)))

    kind = pixels.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, y int, x int, " + ", ".join(f"{c} int" for c in columns)
    return pixels.select(*KEY, *columns).groupBy("image_id").cogroup(geometry.select(F.col("image_id").alias("turned"), "c", "s", "new_w", "new_h").groupBy("turned")).applyInArrow(run, schema)
