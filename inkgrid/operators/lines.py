"""Straight lines and skew: an accumulator over angle and distance, then sessions along its peaks."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.pictures import layout, plane
from inkgrid.functions.scalar import trig_table
from inkgrid.operators.neighborhood import sobel, thin_edges
from inkgrid.operators.regions import keep_strong


def canny_edges(pixels: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """Sobel, thinning, hysteresis: 255 on edges, else 0."""
    return keep_strong(thin_edges(sobel(pixels)), low, high)


_TRIG = np.array(trig_table())


def cast_votes(mask: np.ndarray, top: int = 0) -> tuple[np.ndarray, ...]:
    """Lit pixels of scanlines from ``top`` on, and by angle and pixel the distance of its line to the origin."""
    y, x = (a.astype(np.int64) for a in np.nonzero(mask > 0))
    y = y + top
    # Whole numbers of 32 bits hold the products of pictures of up to 130,000 scanlines and columns together.
    kind = np.int32 if top + sum(mask.shape) < 130_000 else np.int64
    c, s = (_TRIG[:, k].astype(kind)[:, None] for k in (1, 2))
    return y, x, (x.astype(kind) * c + y.astype(kind) * s + kind(8192)) >> 14


def along(theta: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of pixels along the lines of an angle."""
    _, c, s = _TRIG[theta].tolist()
    return (y * c - x * s) >> 14


@lru_cache(maxsize=1024)
def most_votes(height: int, width: int) -> int:
    """Votes of the longest line of a picture, all of whose pixels are lit: no line of such a picture has more."""
    return int(accumulated(cast_votes(np.ones((height, width), np.uint8))[2])[0].max(initial=0)) if height * width else 0


def may_have_lines(height: int, width: int, threshold: int) -> bool:
    """Whether a line of such a picture can have that many votes. Asked of small pictures only, where it costs little."""
    return height * width > 1 << 16 or most_votes(height, width) >= threshold


def _peaks(rho: np.ndarray, threshold: int) -> np.ndarray:
    """Angle, distance and votes of the accumulator's local maxima."""
    if not rho.size:
        return np.zeros((0, 3), np.int64)
    return peaks_of(*accumulated(rho), threshold)


def accumulated(rho: np.ndarray) -> tuple[np.ndarray, int]:
    """Votes by angle and distance, and the least distance."""
    low, n = int(rho.min()), int(rho.max()) - int(rho.min()) + 1
    angles = np.arange(len(rho))[:, None]
    return np.bincount((angles * n + rho - low).ravel(), minlength=len(rho) * n).reshape(-1, n), low


def peaks_of(votes: np.ndarray, low: int, threshold: int) -> np.ndarray:
    """Angle, distance and votes of local maxima."""
    votes, low = np.pad(votes, 1), low - 1
    own = votes[1:-1, 1:-1]
    top = (own >= threshold) & (own > votes[1:-1, :-2]) & (own > votes[:-2, 1:-1]) & (own >= votes[1:-1, 2:]) & (own >= votes[2:, 1:-1])
    theta, at = np.nonzero(top)
    return np.stack([theta, at + low + 1, own[theta, at]], axis=1)


def plane_votes(mask: np.ndarray, threshold: int) -> np.ndarray:
    """``hough_votes`` of a whole picture: rows of theta, rho, n."""
    return _peaks(cast_votes(mask)[2], threshold) if may_have_lines(*mask.shape, threshold) else np.zeros((0, 3), np.int64)


def hough_votes(mask: DataFrame, threshold: int = 100) -> DataFrame:
    """Local maxima of the accumulator with at least ``threshold`` votes: image_id, theta, rho, n.

    The accumulator of one picture, 180 times its diagonal, stands in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        found = _peaks(cast_votes(plane(table, "v", *layout(table)))[2], threshold)
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(found)), "theta": found[:, 0].astype(np.int32), "rho": found[:, 1].astype(np.int32), "n": found[:, 2]})

    kind = mask.schema["image_id"].dataType.simpleString()
    return mask.groupBy("image_id").applyInArrow(run, f"image_id {kind}, theta int, rho int, n long")


def line_segments(mask: DataFrame, threshold: int = 100, min_length: int = 100, max_gap: int = 10) -> DataFrame:
    """Segments on the accumulator's peaks: pixels of a line in order, cut where they lie more than ``max_gap`` apart; x1 <= x2."""

    def run(table: pa.Table) -> pa.Table:
        found = plane_segments(plane(table, "v", *layout(table)), threshold, min_length, max_gap)
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(found)), **{c: found[:, i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}})

    kind = mask.schema["image_id"].dataType.simpleString()
    return mask.groupBy("image_id").applyInArrow(run, f"image_id {kind}, x1 int, y1 int, x2 int, y2 int")


def plane_segments(mask: np.ndarray, threshold: int, min_length: int, max_gap: int) -> np.ndarray:
    """``line_segments`` of a whole picture: rows of x1, y1, x2, y2."""
    if not may_have_lines(*mask.shape, threshold):
        return np.zeros((0, 4), np.int32)
    y, x, rho = cast_votes(mask)
    peaks = _peaks(rho, threshold)
    ends, held, size = [np.zeros((0, 4), np.int32)], [], 0
    if len(peaks):
        low = int(rho.min())
        number = np.full(int(rho.max()) - low + 1, -1)
        # Peaks are in order of angles: the pixels of an angle's lines are found together.
        begin = np.flatnonzero(np.diff(peaks[:, 0], prepend=-1))
        for first, last in zip(begin.tolist(), [*begin[1:].tolist(), len(peaks)], strict=True):
            theta, own = int(peaks[first, 0]), peaks[first:last, 1] - low
            number[own] = np.arange(first, last)
            line = number[rho[theta] - low]
            number[own] = -1
            on = np.flatnonzero(line >= 0)
            held.append((line[on], along(theta, y[on], x[on]), x[on], y[on]))
            size += len(on)
            if size >= CUT:
                ends.append(_stretches(held, min_length, max_gap))
                held, size = [], 0
    if held:
        ends.append(_stretches(held, min_length, max_gap))
    return np.concatenate(ends)


#: Pixels of lines that are cut into stretches together, or those of one angle.
CUT = 1 << 20


def _stretches(held: list[tuple[np.ndarray, ...]], min_length: int, max_gap: int) -> np.ndarray:
    """Of the pixels of lines (number of the line, place along it, x, y): the first and last one, by x and y, of each long stretch."""
    line, pos, x, y = (np.concatenate(a).astype(np.int64) for a in zip(*held, strict=True))
    pos, tall = pos - pos.min(), int(y.max()) + 1
    order = np.argsort(line * (int(pos.max()) + 1) + pos)
    line, pos, place = line[order], pos[order], (x * tall + y)[order]
    begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (pos[1:] - pos[:-1] > max_gap)]))
    long = pos[np.append(begin[1:], len(pos)) - 1] - pos[begin] >= min_length
    least, most = (f.reduceat(place, begin)[long] for f in (np.minimum, np.maximum))
    return np.stack([least // tall, least % tall, most // tall, most % tall], axis=1).astype(np.int32)


def median_angle(segments: np.ndarray) -> float | None:
    """``skew_angle`` of one picture's segments: its median angle where it is worth correcting, else None."""
    x1, y1, x2, y2 = segments.T.astype(float)
    angle = np.degrees(np.arctan2(y2 - y1, x2 - x1))
    angle = angle[(angle > -45) & (angle < 45)]
    if not len(angle):
        return None
    found = float(Decimal(repr(float(np.median(angle)))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return found if 0.5 <= abs(found) <= 30 else None


def skew_angle(segments: DataFrame, images: DataFrame) -> DataFrame:
    """Median angle of each image's near-horizontal segments, and whether it is worth correcting (0.5 to 30 degrees)."""
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    angles = segments.select("image_id", angle.alias("angle")).where("angle > -45 and angle < 45")
    found = angles.groupBy("image_id").agg(F.count("*").alias("n_lines"), F.round(F.median("angle"), 9).alias("median_angle"))
    size = F.abs("median_angle")
    return images.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "median_angle", F.coalesce((size >= 0.5) & (size <= 30), F.lit(False)).alias("applied"))
