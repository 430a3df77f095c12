"""Column helpers shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rint2(x: Column) -> Column:
    """Two digits, half to even on ``x * 100``."""
    return F.rint(x * 100) / 100


def gaussian_weights(k: int) -> list[int]:
    """Integer weights that sum to 65536, for the standard deviation that belongs to the kernel size."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    out = [int(x / sum(raw) * 65536 + 0.5) for x in raw]
    out[k // 2] += 65536 - sum(out)
    return out


def ellipse_half_widths(k: int) -> list[int]:
    """Half width of a ``k`` by ``k`` ellipse on each of its rows (odd ``k``)."""
    r = k // 2
    return [int(math.floor(r * math.sqrt((r * r - d * d) / (r * r)) + 0.5)) if r else 0 for d in range(-r, r + 1)]


def trig_table() -> list[tuple[int, int, int]]:
    """Degree, cosine and sine times 16384, for 0 to 179 degrees."""
    return [(t, round(math.cos(math.radians(t)) * 16384), round(math.sin(math.radians(t)) * 16384)) for t in range(180)]


def cubic_weights() -> list[list[int]]:
    """Four integer weights (sum 2048) of cubic interpolation with a = -0.75, for each 32nd of a pixel."""
    out = []
    for i in range(32):
        x, a = i / 32, -0.75
        w = [((a * (x + 1) - 5 * a) * (x + 1) + 8 * a) * (x + 1) - 4 * a, ((a + 2) * x - (a + 3)) * x * x + 1, ((a + 2) * (1 - x) - (a + 3)) * (1 - x) * (1 - x) + 1]
        q = [round(2048 * v) for v in w]
        out.append([*q, 2048 - sum(q)])
    return out
