"""Pictures in bands against the same operators on whole pictures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid import catalog, fixtures
from inkgrid.functions import bands as bn
from inkgrid.functions.tables import beside, written
from inkgrid.operators import banded, geometry, lines, neighborhood, pictured, regions, stats
from inkgrid.plans import pipelines

SMALL = "/root/testdata/sf0.001"
GRAY = "image_id string, y int, x int, v int"


def spiral(n: int) -> np.ndarray:
    """One line that winds inwards through all bands, and a speck between its turns."""
    a = np.zeros((n, n), int)
    y = x = 0
    dy, dx, low, high = 0, 1, [0, 0], [n - 1, n - 1]
    for turn in range(2 * n):
        a[y, x] = 255
        steps = 0
        while low[0] <= y + dy <= high[0] and low[1] <= x + dx <= high[1]:
            y, x, steps = y + dy, x + dx, steps + 1
            a[y, x] = 255
        if not steps:
            break
        if turn >= 0:
            low, high = ([low[0] + 2 * (dx == 1), low[1] + 2 * (dy == -1)], [high[0] - 2 * (dx == -1), high[1] - 2 * (dy == 1)])
        dy, dx = dx, -dy
    return a


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(9)
    found = {f"p{h}x{w}": rng.integers(0, 256, (h, w)) for h, w in ((37, 23), (5, 9), (1, 1), (3, 40), (64, 8))}
    found["smooth"] = (np.add.outer(np.arange(45) * 5, np.arange(31) * 3) % 200) + rng.integers(0, 9, (45, 31))
    found["spiral"] = spiral(33)
    found["mask"] = np.where(rng.random((50, 40)) < 0.45, 255, 0)
    return found


@pytest.fixture(scope="module")
def gray(spark, pictures):
    rows = [(i, y, x, int(v)) for i, a in pictures.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, GRAY).cache()


@pytest.fixture(scope="module", params=[4, 13])
def cut(gray, request):
    return bn.bands_of_pixels(gray, request.param)


def same(a, b):
    columns = sorted(b.columns)
    one, two = (sorted(map(tuple, d.select(*columns).collect())) for d in (a, b))
    assert one == two and one


def test_bands_round_trip(spark, gray, cut, pictures):
    same(bn.pixels_of_bands(cut), gray)
    rows = spark.createDataFrame([(i, *a.shape, 1, a.astype(np.uint8).tobytes()) for i, a in pictures.items()], "image_id string, height int, width int, n_channels int, data binary")
    same(bn.pixels_of_bands(bn.bands_of_pictures(rows, 6)), gray)
    for broken in (gray.where("image_id <> 'mask' or y <> 20 or x <> 3"), gray.where("image_id <> 'mask' or y not between 4 and 30")):
        with pytest.raises(Exception, match="missing or repeated"):
            bn.bands_of_pixels(broken, 4).collect()


def test_neighbourhoods(gray, cut):
    pairs = [
        (banded.gaussian_blur(cut, 5), neighborhood.gaussian_blur(gray, 5)),
        (banded.gaussian_blur(cut, 51), neighborhood.gaussian_blur(gray, 51)),
        (banded.dilate(cut, 15, 3), neighborhood.dilate(gray, 15, 3)),
        (banded.erode(cut, 4, 20), neighborhood.erode(gray, 4, 20)),
        (banded.morph_close(cut), neighborhood.morph_close(gray)),
        (banded.morph_open(cut, 6, 6), neighborhood.morph_open(gray, 6, 6)),
        (banded.morph_close_ellipse(cut, 7), neighborhood.morph_close_ellipse(gray, 7)),
        (banded.morph_close_ellipse(cut, None), neighborhood.morph_close_ellipse(gray, None)),
        (banded.thin_edges(cut), neighborhood.thin_edges(neighborhood.sobel(gray)).withColumnRenamed("m", "v")),
    ]
    for one, two in pairs:
        same(bn.pixels_of_bands(one), two)


def test_statistics(gray, cut):
    same(bn.pixels_of_bands(banded.clahe_apply(cut)), stats.clahe_apply(gray))
    same(banded.otsu_threshold(cut), stats.otsu_threshold(gray))
    same(banded.blur_score(cut), stats.blur_score(gray))


def test_regions_and_edges(gray, cut):
    """A component may wind through all bands of its picture; ids stay those of the whole picture."""
    shapes = gray.where("image_id in ('spiral', 'mask')")
    lit = cut.where("image_id in ('spiral', 'mask')")
    same(banded.connected_runs(lit), regions.connected_runs(regions.row_runs(shapes)))
    found = banded.connected_components(lit)
    same(found, regions.connected_components(shapes))
    assert found.where("image_id = 'spiral'").count() == 1
    same(bn.pixels_of_bands(banded.canny_edges(cut)), lines.canny_edges(gray))


@pytest.mark.parametrize(("step", "tile"), [(9, 16), (64, 1024)])
def test_lines_and_rotation(spark, step, tile):
    """Lines through all bands are one; turned pictures are the same, tile by tile."""
    rows = []
    for i, slope in enumerate((-0.12, 0.0, 0.3, 4.0)):
        y, x = np.mgrid[0:72, 0:96]
        a = np.where((y - slope * x) % 24 < 2, 0, 220) if slope < 1 else np.where((x - y / slope) % 30 < 2, 0, 220)
        a[30:50, 40:46] = 220  # a gap in the lines
        rows += [(f"s{i}", int(p), int(q), int(v)) for (p, q), v in np.ndenumerate(a)]
    gray = spark.createDataFrame(rows, GRAY)
    cut = written(bn.bands_of_pixels(gray, step), "bands")
    ink, lit = gray.withColumn("v", F.when(F.col("v") == 0, 255).otherwise(0)), written(bn.bands_of_pixels(gray.withColumn("v", F.when(F.col("v") == 0, 255).otherwise(0)), step), "ink")
    same(banded.hough_votes(lit, 40), lines.hough_votes(ink, 40))
    for gap in (2, 10):
        same(banded.line_segments(lit, 40, 20, gap), lines.line_segments(ink, 40, 20, gap))
    skew = lines.skew_angle(lines.line_segments(ink, 40, 20, 10), gray)
    g = geometry.rotation_geometry(skew, stats.extents(gray))
    assert skew.where("applied").count() > 0
    same(bn.pixels_of_bands(banded.rotate_gather(cut, g, tile)), geometry.rotate_gather(gray, g))
    s = pipelines.Settings(votes=40, min_length=20, max_gap=10)
    same(bn.pixels_of_bands(banded.correct_rotation(cut, 40, 20, 10)), pipelines.correct_rotation(gray, s))


def test_small_pictures_meet_and_large_ones_do_not(spark, monkeypatch):
    """Votes and segments are the same either way; small pictures and small target bands share Python calls."""
    y, x = np.mgrid[0:40, 0:52]
    rows = [(f"s{i}", 40, 52, 1, np.where((y - m * x) % 15 < 2, np.uint8(255), np.uint8(0)).tobytes()) for i, m in enumerate((-0.2, 0.1, 0.3))]
    rows.append(("blank", 40, 52, 1, bytes(40 * 52)))
    cut = written(bn.bands_of_pictures(spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary"), 7), "bands")
    steps = (lambda: banded.hough_votes(cut, 25), lambda: banded.line_segments(cut, 25, 15, 5), lambda: bn.pixels_of_bands(banded.correct_rotation(cut, 25, 15, 5)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = [step() for step in steps]
    small = banded._of_wholes(cut, lambda m: lines.plane_segments(m, 25, 15, 5), "x1 int, y1 int, x2 int, y2 int")
    same(whole[1], small)
    g = geometry.rotation_geometry(lines.skew_angle(small, cut), banded.sizes(cut))
    assert "FlatMapGroups" not in plan(banded.rotate_gather(cut, written(g, "geometry"))) and g.where("c < 1048576").count()
    whole = [sorted(map(tuple, w.collect())) for w in whole]
    monkeypatch.setattr(banded, "MAX_WHOLE", 0)
    assert [sorted(map(tuple, step().select(*c).collect())) for step, c in zip(steps, (["image_id", "theta", "rho", "n"], ["image_id", "x1", "y1", "x2", "y2"], ["image_id", "y", "x", "v"]), strict=True)] == whole and all(whole)


def test_no_bands(spark):
    none = bn.bands_of_pixels(spark.createDataFrame([], GRAY), 4)
    for found in (banded.morph_close(none), banded.clahe_apply(none), banded.otsu_threshold(none), banded.connected_components(none), banded.canny_edges(none), banded.correct_rotation(none)):
        assert found.count() == 0


def test_closing_exchanges_bytes_once(cut):
    plan = banded.morph_close(written(cut, "bands"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert banded.morph_close(cut).agg(F.max(F.length("data"))).first()[0] > 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_pictures_are_never_broadcast(spark, monkeypatch, few):
    """Whatever Spark takes their size for, bands and pictures are joined to geometry without being broadcast, with the same result."""
    monkeypatch.setattr(banded, "beside", lambda pictures, narrow, least=0: beside(pictures, narrow, few))
    monkeypatch.setattr(pictured, "beside", lambda pictures, narrow, least=0: beside(pictures, narrow, few))
    rows = fixtures.ruling_pictures(spark, SMALL)
    angles = written(rows.selectExpr("image_id", "2.0 * (image_id % 5) as median_angle", "true as applied"), "angles")
    turned = geometry.rotation_geometry(angles, pictured.sizes(rows))
    whole = pictured.rotate_gather(rows, turned)
    cut = bn.pixels_of_bands(banded.rotate_gather(bn.bands_of_pictures(rows, 13), turned))
    for found in (whole, cut, catalog.queries()["banded_rotation"](spark, SMALL)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BuildLeft" not in plan and ("SortMergeJoin" in plan) == (few == 0)
    same(cut, whole)
