"""Connected regions of masks, worked on as horizontal runs and never as pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.pictures import map_pictures


def row_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs of non-zero pixels: image_id, y, x1, x2."""
    lit = mask.where("v > 0")
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return lit.withColumn("island", island).groupBy("image_id", "y", "island").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("island")


def labels(y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """For each of a picture's runs, ordered by (y, x1), the first run of its component.

    Runs of neighbouring scanlines touch if they overlap by one pixel or meet at a corner; roots that
    touch are hooked to the smaller one until nothing changes.
    """
    wide = int(x2.max()) + 3
    low = np.searchsorted(y * wide + x2 + 1, (y + 1) * wide + x1, "left")
    high = np.searchsorted(y * wide + x1, (y + 1) * wide + x2 + 1, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(a))
    return hooked(np.arange(len(y)), a, b)


def hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each one's component, where ``a`` and ``b`` are linked."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label = label[label]


def plane_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row_runs`` of a whole picture, by (y, x1)."""
    edge = np.diff(np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, x1), (_, x2) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return y, x1, x2 - 1


def component_rows(label: np.ndarray, y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, ...]:
    """By component and scanline, in order: label, y, least x1, largest x2, pixels."""
    order = np.lexsort((y, label))
    label, y, x1, x2 = label[order], y[order], x1[order], x2[order]
    first = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
    if not len(first):
        return (label,) * 5
    return label[first], y[first], np.minimum.reduceat(x1, first), np.maximum.reduceat(x2, first), np.add.reduceat(x2 - x1 + 1, first)


def largest_boxes(masks: np.ndarray, least_share: float = 0.05) -> list[tuple[int, int, int, int] | None]:
    """``largest_region_box`` of each picture of a stack: x, y, w, h, or None. An empty scanline parts the pictures."""
    n, height, width = masks.shape
    y, x1, x2 = plane_runs(np.pad(masks, ((0, 0), (0, 1), (0, 0))).reshape(-1, width))
    out: list[tuple[int, int, int, int] | None] = [None] * n
    if not len(y):
        return out
    label, y, lo, hi, _ = component_rows(labels(y, x1, x2), y, x1, x2)
    wide, first = hi - lo, np.flatnonzero(np.diff(label, prepend=-1) != 0)
    following = np.append(np.where(label[1:] == label[:-1], wide[1:] + wide[:-1], 0), 0)
    twice, picture = np.add.reduceat(following, first), y[first] // (height + 1)
    # Components in order of their first runs, so the first wins a tie.
    order = np.lexsort((np.arange(len(first)), -twice, picture))
    top = order[np.flatnonzero(np.diff(picture[order], prepend=-1) != 0)]
    left, right, low, high = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    for k in top[twice[top] / 2 >= least_share * height * width].tolist():
        p = int(picture[k])
        out[p] = int(left[k]), int(low[k]) - p * (height + 1), int(right[k] - left[k] + 1), int(high[k] - low[k] + 1)
    return out


def strong_planes(m: np.ndarray, low: int, high: int) -> np.ndarray:
    """``keep_strong`` of each picture of a stack. A scanline that does not exceed ``low`` parts the pictures."""
    n, height, width = m.shape
    tall = np.pad(m, ((0, 0), (0, 1), (0, 0)), constant_values=low).reshape(-1, width)
    return strong_plane(tall, low, high).reshape(n, height + 1, width)[:, :height]


def strong_plane(m: np.ndarray, low: int, high: int) -> np.ndarray:
    """``keep_strong`` of a whole picture."""
    y, x1, x2 = plane_runs(m > low)
    out = np.zeros(m.shape, np.int32)
    if len(y):
        # An empty slot after each run, so that reduceat sees runs only.
        ends = np.stack([y * m.shape[1] + x1, y * m.shape[1] + x2 + 1], axis=1).ravel()
        most = np.maximum.reduceat(np.append(m.ravel(), 0), ends)[::2]
        label = labels(y, x1, x2)
        best = np.zeros(len(y), m.dtype)
        np.maximum.at(best, label, most)
        edge = np.zeros((m.shape[0], m.shape[1] + 1), np.int32)
        kept = best[label] > high
        edge[y[kept], x1[kept]] = 255
        edge[y[kept], x2[kept] + 1] -= 255
        out = np.cumsum(edge, axis=1)[:, :-1]
    return out


def connected_runs(runs: DataFrame) -> DataFrame:
    """Runs with the id of their 8-connected component: image_id, y, x1, x2, comp_y, comp_x (its first run).

    A component never leaves its picture, so the runs of one picture are labelled in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        y, x1, x2 = (table[c].to_numpy().astype(np.int64) for c in ("y", "x1", "x2"))
        order = np.lexsort((x1, y))
        first = np.empty(len(y), np.int64)
        first[order] = order[labels(y[order], x1[order], x2[order])]
        return table.append_column("comp_y", pa.array(y[first].astype(np.int32))).append_column("comp_x", pa.array(x1[first].astype(np.int32)))

    kind = runs.schema["image_id"].dataType.simpleString()
    return runs.select("image_id", "y", "x1", "x2").groupBy("image_id").applyInArrow(run, f"image_id {kind}, y int, x1 int, x2 int, comp_y int, comp_x int")


def connected_components(mask: DataFrame) -> DataFrame:
    """One row per component: its first run, bounding box, pixels and outline area.

    The area is that of the polygon through the row extents: half the sum of neighbouring extents.
    """
    return components_of_runs(connected_runs(row_runs(mask)))


def components_of_runs(runs: DataFrame) -> DataFrame:
    by = ["image_id", "comp_y", "comp_x"]
    rows = runs.groupBy(*by, "y").agg(F.min("x1").alias("lo"), F.max("x2").alias("hi"), F.sum(F.col("x2") - F.col("x1") + 1).alias("px"))
    following = F.lead("wide").over(Window.partitionBy(*by).orderBy("y"))
    rows = rows.withColumn("wide", F.col("hi") - F.col("lo")).withColumn("strip", (F.col("wide") + following) / 2)
    return rows.groupBy(*by).agg(F.min("lo").alias("x"), F.min("y").alias("y"), (F.max("hi") - F.min("lo") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum("px").alias("n_pixels"), F.coalesce(F.sum("strip"), F.lit(0.0)).alias("area"))


def largest_region_box(mask: DataFrame, sizes: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Bounding box of each image's largest region; null if there is none or it is below ``least_share`` of the image."""
    order = Window.partitionBy("image_id").orderBy(F.desc("area"), "comp_y", "comp_x")
    top = connected_components(mask).withColumn("place", F.row_number().over(order)).where("place = 1")
    big = F.col("area") >= least_share * F.col("height") * F.col("width")
    return sizes.join(top, "image_id", "left").select("image_id", "height", "width", *[F.when(big, F.col(c)).alias(c) for c in ("x", "y", "w", "h")])


def keep_strong(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Hysteresis: connected pixels above ``low`` stay where one of them exceeds ``high``, picture by picture."""
    return map_pictures(edges.select("image_id", "y", "x", F.col("m").alias("v")), lambda m: strong_plane(m, low, high))
