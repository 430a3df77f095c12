"""Neighbourhood operators on dense grids: windows over scanlines and columns for neighbours of one step, arrays for wide kernels.

Functions of planes take a picture, or a stack of pictures of one shape along a first axis.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkgrid.functions.pictures import map_pictures, reflected, slide
from inkgrid.functions.scalar import ellipse_half_widths, gaussian_weights

KEY = ("image_id", "y", "x")


def scanline() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def _sides(v: str, window) -> tuple[Column, Column]:  # noqa: ANN001
    """Neighbours before and after, reflected at the border without repeating it."""
    before, after = F.lag(v).over(window), F.lead(v).over(window)
    return F.coalesce(before, after, F.col(v)), F.coalesce(after, before, F.col(v))


def laplacian(pixels: DataFrame) -> DataFrame:
    """Sum of the four neighbours less four times the pixel."""
    left, right = _sides("v", scanline())
    up, down = _sides("v", column())
    return pixels.withColumn("lr", left + right).withColumn("ud", up + down).select(*KEY, (F.col("lr") + F.col("ud") - 4 * F.col("v")).alias("g"))


def sobel(pixels: DataFrame) -> DataFrame:
    """3x3 Sobel derivatives: gx, gy."""
    left, right = _sides("v", scanline())
    first = pixels.withColumn("dx", right - left).withColumn("sx", left + 2 * F.col("v") + right)
    dx_up, dx_down = _sides("dx", column())
    sx_up, sx_down = _sides("sx", column())
    return first.select(*KEY, (dx_up + 2 * F.col("dx") + dx_down).alias("gx"), (sx_down - sx_up).alias("gy"))


def around(v: np.ndarray, dy: int, dx: int, border: int | None = None) -> np.ndarray:
    """The picture, or each of a stack, moved so that each place holds its neighbour at (dy, dx); reflected at the border, or ``border`` there."""
    if border is not None:
        h, w = v.shape[-2:]
        return np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1)] * 2, constant_values=border)[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    for axis, d in ((-2, dy), (-1, dx)):
        v = np.take(v, reflected(np.arange(v.shape[axis]) + d, v.shape[axis]), axis) if d else v
    return v


def laplacian_plane(v: np.ndarray) -> np.ndarray:
    return around(v, 0, -1) + around(v, 0, 1) + around(v, -1, 0) + around(v, 1, 0) - 4 * v


def thinned_plane(v: np.ndarray) -> np.ndarray:
    """``thin_edges`` of ``sobel`` of a whole picture."""
    return thinned(around(v, -1, 0), v, around(v, 1, 0))


def gradients_plane(up: np.ndarray, here: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sobel`` of scanlines ``here`` between those above and below: gx, gy."""
    dx = [around(a, 0, 1) - around(a, 0, -1) for a in (up, here, down)]
    sx = [around(a, 0, -1) + 2 * a + around(a, 0, 1) for a in (up, down)]
    return dx[0] + 2 * dx[1] + dx[2], sx[1] - sx[0]


def thinned(up: np.ndarray, here: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Thinned magnitudes of scanlines ``here`` between those above and below; outside of them magnitudes count as 0."""
    gx, gy = gradients_plane(up, here, down)
    m = np.abs(gx) + np.abs(gy)
    return np.where(_stays(m, gx, gy, lambda dy, dx: around(m, dy, dx, 0)), m, 0)


def _stays(m: np.ndarray, gx: np.ndarray, gy: np.ndarray, at: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Whether a magnitude exceeds its neighbour before along the gradient and is not below the one after."""
    ax, ay = np.abs(gx).astype(np.int64), np.abs(gy).astype(np.int64)
    pairs = (((0, -1), (0, 1)), ((-1, 0), (1, 0)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1)))
    flat, steep, falling, rising = ((m > at(*before)) & (m >= at(*after)) for before, after in pairs)
    return np.select([ay * 32768 < ax * 13573, ay * 32768 > ax * 79109, gx.astype(np.int64) * gy > 0], [flat, steep, falling], rising)


def thin_edges(gradients: DataFrame) -> DataFrame:
    """Non-maximum suppression of the L1 magnitude along the gradient: magnitude m, or 0.

    The direction is one of four sectors, cut at 22.5 and 67.5 degrees in integers (tan times 32768).
    A pixel stays if it exceeds its neighbour before and is not below the one after.
    """
    m = gradients.withColumn("m", F.abs("gx") + F.abs("gy"))
    near = m.withColumn("l", F.coalesce(F.lag("m").over(scanline()), F.lit(0))).withColumn("r", F.coalesce(F.lead("m").over(scanline()), F.lit(0)))
    around = {"u": ("m", F.lag), "d": ("m", F.lead), "ul": ("l", F.lag), "ur": ("r", F.lag), "dl": ("l", F.lead), "dr": ("r", F.lead)}
    for name, (source, shift) in around.items():
        near = near.withColumn(name, F.coalesce(shift(source).over(column()), F.lit(0)))
    ax, ay, v = F.abs("gx").cast("long"), F.abs("gy").cast("long"), F.col("m")
    flat, steep = ay * 32768 < ax * 13573, ay * 32768 > ax * 79109
    falling = F.col("gx") * F.col("gy") > 0
    keep = F.when(flat, (v > F.col("l")) & (v >= F.col("r"))).when(steep, (v > F.col("u")) & (v >= F.col("d"))).when(falling, (v > F.col("ul")) & (v >= F.col("dr"))).otherwise((v > F.col("ur")) & (v >= F.col("dl")))
    return near.select(*KEY, F.when(keep, v).otherwise(0).alias("m"))


def gaussian_blur(pixels: DataFrame, k: int = 51) -> DataFrame:
    """Separable blur in exact integers, scanlines before columns; borders reflected, other columns kept."""
    return map_pictures(pixels, lambda v: blurred_plane(v, k))


def blurred_plane(v: np.ndarray, k: int) -> np.ndarray:
    place = reflected(np.arange(-(k // 2), v.shape[-2] + k - 1 - k // 2), v.shape[-2])
    return along_columns(along_rows(v, k)[..., place, :], k)


def along_rows(v: np.ndarray, k: int) -> np.ndarray:
    n = v.shape[-1]
    padded = v[..., reflected(np.arange(-(k // 2), n + k - 1 - k // 2), n)].astype(np.int64)
    return sum(w * padded[..., i : i + n] for i, w in enumerate(gaussian_weights(k))) + 32768 >> 16


def along_columns(padded: np.ndarray, k: int) -> np.ndarray:
    """Down the columns of scanlines that reach ``k - 1`` beyond those asked for."""
    n = padded.shape[-2] - k + 1
    return sum(w * padded[..., i : i + n, :] for i, w in enumerate(gaussian_weights(k))) + 32768 >> 16


def rect_plane(a: np.ndarray, kw: int, kh: int, highest: bool) -> np.ndarray:
    return slide(slide(a, kw // 2, kw - 1 - kw // 2, -1, highest), kh // 2, kh - 1 - kh // 2, -2, highest)


def dilate(pixels: DataFrame, kw: int, kh: int) -> DataFrame:
    """Largest value in a rectangle anchored at ``k // 2``; pixels outside the image do not count."""
    return map_pictures(pixels, lambda v: rect_plane(v, kw, kh, True))


def erode(pixels: DataFrame, kw: int, kh: int) -> DataFrame:
    return map_pictures(pixels, lambda v: rect_plane(v, kw, kh, False))


def morph_close(pixels: DataFrame, kw: int = 35, kh: int = 35) -> DataFrame:
    return map_pictures(pixels, lambda v: rect_plane(rect_plane(v, kw, kh, True), kw, kh, False))


def closed_plane(v: np.ndarray, k: int) -> np.ndarray:
    return rect_plane(rect_plane(v, k, k, True), k, k, False)


def opened_plane(v: np.ndarray, k: int) -> np.ndarray:
    return rect_plane(rect_plane(v, k, k, False), k, k, True)


def dilated_plane(v: np.ndarray, kw: int, kh: int) -> np.ndarray:
    return rect_plane(v, kw, kh, True)


def morph_open(pixels: DataFrame, kw: int = 20, kh: int = 20) -> DataFrame:
    return map_pictures(pixels, lambda v: rect_plane(rect_plane(v, kw, kh, False), kw, kh, True))


def _ellipse(a: np.ndarray, k: int, highest: bool) -> np.ndarray:
    """An ellipse is a stack of rows: one horizontal pass for each width, then one shifted read for each row."""
    pick, least = (np.maximum, np.iinfo(a.dtype).min) if highest else (np.minimum, np.iinfo(a.dtype).max)
    widths, height = ellipse_half_widths(k), a.shape[-2]
    lines = {d: slide(a, d, d, -1, highest) for d in set(widths)}
    out = np.full_like(a, least)
    for i, d in enumerate(widths):
        down = i - k // 2
        low, high = max(0, -down), min(height, height - down)
        if low < high:
            out[..., low:high, :] = pick(out[..., low:high, :], lines[d][..., low + down : high + down, :])
    return out


def background_kernel(height: int, width: int, least: int = 51) -> int:
    """Odd, a tenth of the longer side, ``least`` at least."""
    k = max(height, width) // 10
    return max(k if k % 2 else k + 1, least)


def morph_close_ellipse(pixels: DataFrame, k: int | None = 51) -> DataFrame:
    """Closing with a ``k`` by ``k`` ellipse (odd ``k``): an estimate of the background. Without ``k`` each picture gets its own by its size."""
    return map_pictures(pixels, lambda v: background_plane(v, k))


def background_plane(v: np.ndarray, k: int | None) -> np.ndarray:
    own = k or background_kernel(*v.shape[-2:])
    return _ellipse(_ellipse(v, own, True), own, False)
