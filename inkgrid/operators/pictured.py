"""Operators on picture rows: the results of those on pixel rows, without a shuffle of pixels.

A picture is one row of bytes until its last step, and pictures of one shape are worked on as a stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.pictures import PICTURE, by_shape, map_rows, pictures_of, pixels_of, rows_of_pictures, unpacked
from inkgrid.functions.tables import beside
from inkgrid.operators import geometry, lines, neighborhood, pixels, regions, stats

# Neighbourhoods.


def laplacian(rows: DataFrame) -> DataFrame:
    return pixels_of(rows, lambda v: neighborhood.laplacian_plane(v.astype(np.int32)), ("g",))


def _gray(rows: np.ndarray) -> np.ndarray:
    """A stack of gray pictures, or the luma of one in colour."""
    return pixels.luma_plane(rows) if rows.ndim == 4 else rows.astype(np.int32)


def sobel(rows: DataFrame) -> DataFrame:
    """Gradients of gray pictures, or of the luma of pictures in colour."""

    def change(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = _gray(a)
        return neighborhood.gradients_plane(neighborhood.around(v, -1, 0), v, neighborhood.around(v, 1, 0))

    return pixels_of(rows, change, ("gx", "gy"))


def dilate(rows: DataFrame, kw: int, kh: int) -> DataFrame:
    return pixels_of(rows, lambda v: neighborhood.rect_plane(v, kw, kh, True))


def erode(rows: DataFrame, kw: int, kh: int) -> DataFrame:
    return pixels_of(rows, lambda v: neighborhood.rect_plane(v, kw, kh, False))


def morph_close(rows: DataFrame, k: int = 35) -> DataFrame:
    return pixels_of(rows, lambda v: neighborhood.closed_plane(v, k))


def morph_open(rows: DataFrame, k: int = 20) -> DataFrame:
    return pixels_of(rows, lambda v: neighborhood.opened_plane(v, k))


def canny_edges(rows: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    return pixels_of(rows, lambda a: regions.strong_planes(neighborhood.thinned_plane(_gray(a)), low, high))


def crop_to_largest(rows: DataFrame, mask: Callable[[np.ndarray], np.ndarray], margin: int = 5, least_share: float = 0.05) -> DataFrame:
    """Pictures cut to the largest region of their masks, as ``largest_region_box`` and ``crop`` do: no box is joined to pixels. ``mask`` gets stacks."""

    def change(stack: np.ndarray) -> list[np.ndarray]:
        return [pixels.cut_plane(p, box, margin) for p, box in zip(stack, regions.largest_boxes(mask(stack), least_share), strict=True)]

    return unpacked(pictures_of(rows, change))


# Statistics.


def blur_score(rows: DataFrame, threshold: float = 100.0) -> DataFrame:
    def change(pictures: list[np.ndarray]) -> list[dict[str, object]]:
        return [{"blur_score": s, "is_blurry": b} for s, b in by_shape(pictures, lambda a: stats.sharpness_each(_gray(a), threshold))]

    return map_rows(rows, change, (), "blur_score double, is_blurry boolean")


def otsu_threshold(rows: DataFrame) -> DataFrame:
    return map_rows(rows, lambda pictures: [{"t": int(t)} for t in by_shape(pictures, lambda a: stats.thresholds(_gray(a)))], (), "t int")


def otsu_binarize(rows: DataFrame) -> DataFrame:
    def change(a: np.ndarray) -> np.ndarray:
        v = _gray(a)
        return np.where(v > stats.thresholds(v)[:, None, None], np.uint8(255), np.uint8(0))

    return pixels_of(rows, change)


def clahe_lut(rows: DataFrame, clip: float = 1.5, tiles: int = 8) -> DataFrame:
    """Look-up table of every tile, one row a tile: image_id, ty, tx, lut (256 values)."""
    ty, tx = np.divmod(np.arange(tiles * tiles), tiles)
    return rows_of_pictures(rows, lambda v: ((ty, tx, t) for t in stats.tables_of_stack(v, clip, tiles)), "ty int, tx int, lut array<int>", tiles * tiles * 256)


def clahe_apply(rows: DataFrame, clip: float = 1.5, tiles: int = 8) -> DataFrame:
    return pixels_of(rows, lambda v: stats.contrast_plane(v, clip, tiles).astype(np.int32), least=tiles * tiles * 256)


# Lines and rotation.


def dilated(rows: DataFrame, kw: int, kh: int) -> DataFrame:
    """``dilate`` to picture rows."""
    return pictures_of(rows, lambda v: neighborhood.rect_plane(v, kw, kh, True))


def _each(find: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, ...]]]:
    return lambda masks: (tuple(find(m).T) for m in masks)


def hough_votes(rows: DataFrame, threshold: int = 100) -> DataFrame:
    """Local maxima of each picture's accumulator: image_id, theta, rho, n."""
    return rows_of_pictures(rows, _each(lambda m: lines.plane_votes(m, threshold)), "theta int, rho int, n long")


def line_segments(rows: DataFrame, threshold: int = 100, min_length: int = 100, max_gap: int = 10) -> DataFrame:
    return rows_of_pictures(rows, _each(lambda m: lines.plane_segments(m, threshold, min_length, max_gap)), "x1 int, y1 int, x2 int, y2 int")


def rotate_gather(rows: DataFrame, geometry_rows: DataFrame) -> DataFrame:
    """Gray pictures turned by their rows of geometry: the two tables are joined, a picture as a row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, c, s, nh, nw, data = (batch.column(n)[i].as_py() for n in ("height", "width", "c", "s", "new_h", "new_w", "data"))
                turned = geometry.turned_planes([np.frombuffer(data, np.uint8).reshape(h, w)], c, s, nh, nw)[0].astype(np.uint8)
                row = {"image_id": batch.column("image_id")[i], "height": nh, "width": nw, "n_channels": 1, "data": turned.tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([batch.schema.field("image_id"), *[batch.schema.field(n) for n in ("height", "width")], pa.field("n_channels", pa.int32()), batch.schema.field("data")]))

    joined = beside(rows.select("image_id", "height", "width", "data"), geometry_rows.select("image_id", "c", "s", "new_h", "new_w"))
    return pixels_of(joined.mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, {PICTURE}"), lambda v: v)


def sizes(rows: DataFrame) -> DataFrame:
    """image_id, height and width of picture rows."""
    return rows.select("image_id", F.col("height"), F.col("width"))
