"""Non-local means on gray and colour images."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from inkgrid.functions.pictures import map_pictures, reflected


#: Padded values that are denoised together, so that a step's arrays stay in a processor's cache, or one picture.
AT_ONCE = 1 << 16


def denoised_plane(v: np.ndarray, h: float, template: int, search: int) -> np.ndarray:
    """A picture or a stack of them, of which some are done at a time."""
    height, width = v.shape[-2:]
    out = np.empty((math.prod(v.shape[:-2]), height, width))
    stack = v.reshape(out.shape)
    n = max(1, AT_ONCE // max(1, (height + search + template) * (width + search + template)))
    for low in range(0, len(out), n):
        out[low : low + n] = _denoised(np.moveaxis(stack[low : low + n], 0, -1), h, template, search).transpose(2, 0, 1)
    return out.reshape(v.shape)


def _denoised(v: np.ndarray, h: float, template: int, search: int) -> np.ndarray:
    """Pictures of one shape along the last axis: a step runs through their like pixels side by side. One pass serves an offset of the search window and its opposite (both sizes odd).

    The patch distance of p and p - o is that of p - o and p, so squared differences of shifted
    pictures, summed over patches, are taken once for both, on the places that either asks for.
    """
    height, width = v.shape[:2]
    t, r = template // 2, search // 2
    down, across = (reflected(np.arange(-r - t, n + r + t), n) for n in (height, width))
    kind = np.int32 if template * template * 65025 < 1 << 31 and 0 <= v.min(initial=0) and v.max(initial=0) < 256 else np.int64
    wide, m = np.ascontiguousarray(v[down[:, None], across], kind), r + t
    real, weights = wide.astype(float), _weights(h, template)
    at = lambda a, y1, y2, x1, x2: a[m + y1 : m + y2, m + x1 : m + x2]
    total, weight, share = np.ascontiguousarray(v, float), np.ones(v.shape), np.empty(v.shape)
    for dy in range(r + 1):
        for dx in range(-r if dy else 1, r + 1):
            x1, x2 = min(0, -dx), width + max(0, -dx)
            apart = at(wide, -dy - t, height + t, x1 - t, x2 + t) - at(wide, -t, height + dy + t, x1 + dx - t, x2 + dx + t)
            np.multiply(apart, apart, out=apart)
            # The last weight, which is nothing, is that of all larger sums.
            w = weights.take(_sums(_sums(apart, template, 0), template, 1), mode="clip")
            for sign, part in ((1, w[dy:, -x1 : width - x1]), (-1, w[:height, -dx - x1 : width - dx - x1])):
                weight += part
                np.multiply(part, at(real, sign * dy, height + sign * dy, sign * dx, width + sign * dx), out=share)
                total += share
    return np.rint(total / weight)


def _sums(a: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Sums of ``k`` neighbours along an axis, by doubling."""
    cut = lambda x, low, high: x[low:high] if axis == 0 else x[:, low:high]
    n, out, seen, step = a.shape[axis] - k + 1, None, 0, 1
    while step <= k:
        if k & step:
            part = cut(a, seen, seen + n)
            out, seen = part if out is None else out + part, seen + step
        if 2 * step <= k:
            a = cut(a, 0, a.shape[axis] - step) + cut(a, step, a.shape[axis])
        step *= 2
    return out


@lru_cache(maxsize=8)
def _weights(h: float, template: int) -> np.ndarray:
    """Weights of the sums of squares of a patch, from 0 up to the first that counts as nothing."""
    last = int(math.log(1000) * h * h * template * template) + 2
    w = np.exp(-(np.arange(last + 1) / (template * template)) / (h * h))
    w[w < 0.001] = 0
    return w


def nlm_denoise(pixels: DataFrame, h: float = 7.0, template: int = 7, search: int = 21) -> DataFrame:
    """Mean of the search window, weighted by the likeness of patches; borders reflected.

    A picture takes half of ``search ** 2`` steps over its pixels, whatever the patch, and some arrays of its size.
    """
    return map_pictures(pixels, lambda v: denoised_plane(v, h, template, search))


def nlm_denoise_bgr(bgr: DataFrame, h: float = 10.0, template: int = 7, search: int = 21) -> DataFrame:
    """The gray operator on each channel, in one pass over the pictures."""
    return map_pictures(bgr, lambda *channels: tuple(denoised_plane(v, h, template, search) for v in channels), ("b", "g", "r"))
