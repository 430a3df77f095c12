"""Hand-made rasters with expected values worked out by hand, and NumPy as a third opinion."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions.scalar import cubic_weights, ellipse_half_widths, gaussian_weights
from inkgrid.operators import denoise, geometry, lines, neighborhood, pixels, regions, stats
from inkgrid.sources import images


def table(spark, *rasters, column="v"):
    rows = [(i, y, x, int(v)) for i, r in enumerate(rasters) for y, line in enumerate(np.atleast_2d(r)) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {column} int")


def raster(df, image=0, column="v"):
    rows = df.where(F.col("image_id") == image).select("y", "x", column).collect()
    out = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), int)
    for y, x, v in rows:
        out[y, x] = v
    return out


def pad(a, n):
    return np.pad(a, n, mode="reflect")


DOT = np.zeros((5, 5), int)
DOT[2, 2] = 9
RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (9, 11))


def test_laplacian_and_blur(spark):
    out = raster(neighborhood.laplacian(table(spark, DOT)), column="g")
    assert out[2, 2] == -36 and out[1, 2] == 9 and out[1, 1] == 0
    assert raster(neighborhood.laplacian(table(spark, np.array([[1, 5, 2]]))), column="g").tolist() == [[8, -7, 6]]
    scores = {r["image_id"]: r for r in stats.blur_score(table(spark, np.full((5, 5), 7), NOISE)).collect()}
    p = pad(NOISE, 1)
    g = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * NOISE
    assert scores[0]["blur_score"] == 0 and scores[0]["is_blurry"]
    assert scores[1]["blur_score"] == pytest.approx(g.var(), abs=0.006) and not scores[1]["is_blurry"]


def test_blur_threshold_is_strict(spark):
    score = stats.blur_score(table(spark, NOISE)).first()["blur_score"]
    raw = table(spark, np.array([[0, 2, 0, 2]]))  # values of the Laplacian are 4 and -4
    assert stats.blur_score(raw, 16.0).first()["is_blurry"] is False
    assert stats.blur_score(raw, 16.1).first()["is_blurry"] is True
    assert score > 100


def test_otsu(spark):
    two = np.array([[10, 10, 200, 200]] * 4)
    got = {r[0]: r[1] for r in stats.otsu_threshold(table(spark, two, np.full((3, 3), 77), RNG.permutation(two.ravel()).reshape(4, 4))).collect()}
    assert got == {0: 10, 1: 0, 2: 10}
    assert raster(pixels.binarize(table(spark, two), stats.otsu_threshold(table(spark, two)))).tolist() == [[0, 0, 255, 255]] * 4


def test_rect_morphology(spark):
    d = raster(neighborhood.dilate(table(spark, DOT), 3, 2))
    assert d[2].tolist() == [0, 9, 9, 9, 0] and d[3].tolist() == [0, 9, 9, 9, 0] and d[1].tolist() == [0] * 5
    t = table(spark, NOISE)
    low, high = raster(neighborhood.erode(t, 3, 3)), raster(neighborhood.dilate(t, 3, 3))
    assert (low <= NOISE).all() and (NOISE <= high).all()
    opened = neighborhood.morph_open(t, 3, 3)
    assert (raster(neighborhood.morph_open(opened, 3, 3)) == raster(opened)).all()
    mask = table(spark, np.where(NOISE > 120, 255, 0))
    flipped = neighborhood.dilate(mask.withColumn("v", 255 - F.col("v")), 3, 3)
    assert (raster(neighborhood.erode(mask, 3, 3)) == 255 - raster(flipped)).all()


def test_gaussian_and_ellipse(spark):
    w = np.array(gaussian_weights(5))
    assert w.sum() == 65536
    p = pad(NOISE, 2)
    rows = sum(w[i] * p[:, i : i + 11] for i in range(5)) + 32768 >> 16
    want = sum(w[i] * rows[i : i + 9] for i in range(5)) + 32768 >> 16
    assert (raster(neighborhood.gaussian_blur(table(spark, NOISE), 5)) == want).all()

    def spread(a, pick, empty):
        out = np.zeros_like(a)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                out[y, x] = pick([a[y + d - 2, x + o] for d, h in enumerate(ellipse_half_widths(5)) for o in range(-h, h + 1) if 0 <= y + d - 2 < a.shape[0] and 0 <= x + o < a.shape[1]])
        return out

    assert (raster(neighborhood.morph_close_ellipse(table(spark, NOISE), 5)) == spread(spread(NOISE, max, 0), min, 255)).all()


def test_hsv_and_gray(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 255), (0, 0, 1, 255, 0, 0), (0, 0, 2, 60, 110, 150), (0, 0, 3, 0, 0, 0)], "image_id long, y int, x int, b int, g int, r int")
    got = [(r["h"], r["s"], r["v"]) for r in pixels.to_hsv(df).orderBy("x").collect()]
    assert got == [(0, 255, 255), (120, 255, 255), (17, 153, 150), (0, 0, 0)]
    assert [r["v"] for r in pixels.to_gray(df).orderBy("x").collect()] == [76, 29, 116, 0]
    assert [r["v"] for r in pixels.range_mask(df).orderBy("x").collect()] == [0, 0, 255, 0]


SPIRAL = np.array([[int(c) for c in line] for line in ["111111111", "100000001", "101111101", "101000101", "101010101", "101011101", "101000001", "101111111", "100000000"]])
U = np.array([[1, 0, 0, 0, 0, 0, 1]] * 6 + [[1] * 7])
CORNERS = np.array([[1, 0], [0, 1]])


def test_components(spark):
    got = regions.connected_components(table(spark, SPIRAL, U, CORNERS, np.array([[1, 0, 1]]))).collect()
    by = {}
    for r in got:
        by.setdefault(r["image_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert by[0][0]["n_pixels"] == SPIRAL.sum() and (by[1][0]["w"], by[1][0]["h"]) == (7, 7)


def test_region_box_and_crop(spark):
    a = np.zeros((20, 20), int)
    a[4:14, 3:15] = 255
    a[17:19, 17:19] = 255
    small = np.zeros((20, 20), int)
    small[0:2, 0:2] = 255
    t = table(spark, a, small, np.zeros((20, 20), int))
    boxes = regions.largest_region_box(t, stats.extents(t))
    got = {r["image_id"]: (r["x"], r["y"], r["w"], r["h"]) for r in boxes.collect()}
    assert got == {0: (3, 4, 12, 10), 1: (None,) * 4, 2: (None,) * 4}
    cut = pixels.crop(t, boxes, 2)
    assert raster(cut, 0).shape == (6, 8) and raster(cut, 1).shape == (20, 20)


def test_clahe_constant_and_ramp(spark):
    ramp = np.arange(256).reshape(16, 16)
    lut = stats.clahe_lut(table(spark, ramp), tiles=2)
    rows = lut.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.max("lut").alias("top")).collect()
    assert len(rows) == 4 and all(r["n"] == 256 and r["top"] == 255 for r in rows)
    out = raster(stats.clahe_apply(table(spark, ramp), tiles=2))
    assert out.shape == (16, 16) and out.min() >= 0 and out.max() <= 255


def test_lines_recover_skew(spark):
    for slope in (-0.2, 0.1):
        y, x = np.mgrid[0:72, 0:96]
        ink = np.where(((y - slope * x) % 16) < 2, 255, 0)
        t = table(spark, ink)
        got = lines.skew_angle(lines.line_segments(neighborhood.dilate(t, 15, 3), 50, 40, 10), t).first()
        assert got["applied"] and abs(got["median_angle"] - np.degrees(np.arctan(slope))) < 1.5


def test_skew_gates(spark):
    rows = [(0, 0, 0, 100, 1), (1, 0, 0, 10, 10), (2, 0, 0, 100, 10), (2, 0, 0, 100, 12)]
    seg = spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int")
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id long")
    got = {r["image_id"]: (r["n_lines"], r["applied"]) for r in lines.skew_angle(seg, images).collect()}
    assert got == {0: (1, True), 1: (0, False), 2: (2, True), 3: (0, False)}  # 45 degrees is not near horizontal


def test_rotation(spark):
    assert all(sum(w) == 2048 for w in cubic_weights())
    t = table(spark, NOISE)
    still = spark.createDataFrame([(0, 0, 0.0, False)], "image_id long, n_lines long, median_angle double, applied boolean")
    assert (raster(geometry.rotate_gather(t, geometry.rotation_geometry(still, stats.extents(t)))) == NOISE).all()
    turned = spark.createDataFrame([(0, 1, 10.0, True)], "image_id long, n_lines long, median_angle double, applied boolean")
    g = geometry.rotation_geometry(turned, stats.extents(t))
    r = g.first()
    assert (r["new_w"], r["new_h"]) == (int(9 * np.sin(np.radians(10)) + 11 * np.cos(np.radians(10))), int(9 * np.cos(np.radians(10)) + 11 * np.sin(np.radians(10))))
    assert geometry.rotate_gather(t, g).count() == r["new_w"] * r["new_h"]


def test_nlm(spark):
    a = NOISE[:6, :6]
    p = pad(a, 3)
    want = np.zeros_like(a)
    for y in range(6):
        for x in range(6):
            n = s = 0.0
            own = p[y + 2 : y + 5, x + 2 : x + 5]
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    other = p[y + dy + 2 : y + dy + 5, x + dx + 2 : x + dx + 5]
                    w = np.exp(-((own - other) ** 2).sum() / 9 / 49.0)
                    w = 0 if w < 0.001 else w
                    n, s = n + w, s + w * p[y + dy + 3, x + dx + 3]
            want[y, x] = np.rint(s / n)
    assert (raster(denoise.nlm_denoise(table(spark, a), template=3, search=5)) == want).all()


def test_one_exchange(spark):
    from inkgrid.functions.tables import by_image

    plan = stats.blur_score(by_image(table(spark, NOISE)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rasters_without_bytes(spark):
    """A picture without bytes or size has no pixels; bytes that do not fit are an error."""
    rows = [("a", 1, 2, 1, bytearray(b"\x01\x02")), ("b", 1, 2, 1, None), ("c", None, 2, 1, bytearray(b"\x01\x02")), ("d", 0, 0, 3, bytearray())]
    kind = "image_id string, height int, width int, n_channels int, data binary"
    assert sorted(tuple(r) for r in images.raster_to_pixels(spark.createDataFrame(rows, kind)).collect()) == [("a", 0, 0, 1, 1, 1), ("a", 0, 1, 2, 2, 2)]
    with pytest.raises(Exception, match="image e has 2 bytes"):
        images.raster_to_pixels(spark.createDataFrame([("e", 1, 3, 1, bytearray(b"\x01\x02"))], kind)).collect()


def test_temporaries(spark):
    """Tables written inside go at the end, also after a failure; kept ones stay."""
    from inkgrid.functions.tables import temporaries, written

    with temporaries(spark):
        inside = written(spark.range(3), "inside")
        kept = written(inside, "kept", keep=True)
    assert kept.count() == 3
    with pytest.raises(ValueError, match="stop"), temporaries(spark):
        failed = written(spark.range(3), "failed")
        raise ValueError("stop")
    for gone in (inside, failed):
        with pytest.raises(Exception):  # noqa: B017
            gone.select("id").where("id >= 0").collect()
    assert written(spark.range(2), "outside").count() == 2
