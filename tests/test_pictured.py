"""Operators on picture rows: the results of pixel rows, without an exchange of pixels."""

from __future__ import annotations

import os
import struct
import tempfile
import tracemalloc
import zlib

import numpy as np
import pytest

from inkgrid import catalog, fixtures
from inkgrid.functions.pictures import packed
from inkgrid.operators import denoise, lines, neighborhood, pictured, pixels, regions, stats
from inkgrid.plans import pipelines
from inkgrid.sources import images

SMALL = "/root/testdata/sf0.001"
KEPT = (
    "clahe_lut image_scan canny_edges sobel_gradient erode_rect dilate_rect morph_close morph_open laplacian blur_score clahe_apply raster_pack "
    "otsu_binarize line_segments correct_rotation correct_rotation_bgr preprocess_binarized preprocess_ocr_ready preprocess_processed preprocess_quality preprocess_full"
).split()


@pytest.mark.parametrize("name", KEPT)
def test_no_pixel_is_shuffled(spark, name):
    """At most rows of the table are dealt out, before there are pictures."""
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    last = plan.rfind("Exchange")
    assert plan.count("Exchange") <= 1 and (last < 0 or "MapInArrow" not in plan[last:])


@pytest.fixture(scope="module")
def gray(spark):
    rng = np.random.default_rng(2)
    shapes = [(37, 23), (1, 1), (1, 9), (5, 9), (5, 9), (40, 3), (24, 32), (24, 32)]
    rows = [(f"p{i}", y, x, int(v)) for i, s in enumerate(shapes) for (y, x), v in np.ndenumerate(rng.integers(0, 256, s) if i % 2 else np.where(rng.random(s) < 0.4, 255, 0))]
    return spark.createDataFrame(rows, "image_id string, y int, x int, v int").cache()


def same(a, b):
    columns = sorted(b.columns)
    one, two = (sorted(map(tuple, d.select(*columns).collect())) for d in (a, b))
    assert one == two


def test_results_of_pixel_rows(gray):
    rows = packed(gray).cache()
    same(pictured.laplacian(rows), neighborhood.laplacian(gray))
    same(pictured.sobel(rows), neighborhood.sobel(gray))
    same(pictured.canny_edges(rows), lines.canny_edges(gray))
    same(pictured.dilate(rows, 15, 3), neighborhood.dilate(gray, 15, 3))
    same(pictured.erode(rows, 4, 20), neighborhood.erode(gray, 4, 20))
    same(pictured.morph_close(rows, 5), neighborhood.morph_close(gray, 5, 5))
    same(pictured.morph_open(rows, 4), neighborhood.morph_open(gray, 4, 4))
    same(pictured.blur_score(rows), stats.blur_score(gray))
    same(pictured.otsu_threshold(rows), stats.otsu_threshold(gray))
    same(pictured.otsu_binarize(rows), pixels.binarize(gray, stats.otsu_threshold(gray)))
    same(pictured.clahe_apply(rows), stats.clahe_apply(gray))
    same(pictured.clahe_lut(rows).selectExpr("image_id", "ty", "tx", "posexplode(lut) as (v, lut)"), stats.clahe_lut(gray))
    same(pictured.hough_votes(rows, 5), lines.hough_votes(gray, 5))
    same(pictured.line_segments(rows, 5, 3, 2), lines.line_segments(gray, 5, 3, 2))


def test_crop_joins_no_pixels(spark, gray):
    """Pictures are cut where they lie, as pixel rows are by their boxes; what Python makes of few rows is never broadcast as pixels."""
    rows = packed(gray).cache()
    bgr = pixels.gray_to_bgr(gray)
    for margin in (0, 1, 9):
        boxes = regions.largest_region_box(gray, pictured.sizes(rows))
        same(pictured.crop_to_largest(rows, lambda v: v, margin), pixels.crop(bgr, boxes, margin))
    plan = catalog.queries()["crop_to_region"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    boxes = packed(gray).selectExpr("image_id", "height", "width", "0 as x", "0 as y", "1 as w", "1 as h")
    for cut in (pixels.crop(bgr, boxes, 0), pixels.binarize(gray, boxes.selectExpr("image_id", "9 as t"))):
        cut.collect()
        assert "SortMergeJoin" in cut._jdf.queryExecution().executedPlan().toString()


def test_stacks_are_pictures():
    """Steps that get a stack give what they give each picture alone."""
    rng = np.random.default_rng(3)
    stack = rng.integers(0, 256, (5, 13, 17))
    masks = np.where(rng.random((7, 12, 15)) < 0.5, 255, 0)
    for step in (lambda v: denoise.denoised_plane(v, 7.0, 3, 5), lambda v: neighborhood.background_plane(v, 5), lambda v: neighborhood.blurred_plane(v, 7)):
        assert (step(stack) == np.stack([step(v) for v in stack])).all()
    assert stats.thresholds(stack).tolist() == [stats.threshold_of(np.bincount(v.ravel())) for v in stack]
    boxes = regions.largest_boxes(masks)
    assert boxes == [regions.largest_boxes(m[None])[0] for m in masks] and any(boxes)
    assert regions.largest_boxes(np.zeros((2, 3, 4))) == [None, None]
    bgr = rng.integers(0, 256, (6, 20, 24, 3)).astype(np.uint8)
    s = pipelines.Settings(blur=5, close=5, open=4, margin=1, background=7, template=3, search=5, votes=50, min_length=40)
    assert all((a == b).all() for a, b in zip(pipelines.cleaned(list(bgr), s), [pipelines.cleaned([p], s)[0] for p in bgr], strict=True))


def test_denoising_works_on_some_pictures_at_a_time(spark):
    """Whatever the stack, its steps hold a few megabytes; preprocessing to digests is one pass of Python after the drawing."""
    stack = np.random.default_rng(6).integers(90, 110, (700, 14, 22))
    tracemalloc.start()
    whole = denoise.denoised_plane(stack, 7.0, 7, 21)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - whole.nbytes < 8 << 20
    assert (whole[::50] == np.stack([denoise.denoised_plane(v, 7.0, 7, 21) for v in stack[::50]])).all() and (whole != stack).any()
    assert denoise._sums(np.arange(12).reshape(3, 4), 3, 1).tolist() == [[3, 6], [15, 18], [27, 30]] and denoise._sums(np.arange(12).reshape(3, 4), 2, 0).tolist() == [[4, 6, 8, 10], [12, 14, 16, 18]]
    plan = catalog.queries()["preprocess_full"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_no_line_has_more_votes_than_a_full_picture():
    full = np.full((24, 32), 255)
    most = lines.most_votes(24, 32)
    assert len(lines.plane_votes(full, most)) and not len(lines.plane_votes(full, most + 1))


def segments_line_by_line(mask, threshold, min_length, max_gap):
    y, x, rho = lines.cast_votes(mask)
    ends = []
    for theta, distance, _ in lines.plane_votes(mask, threshold).tolist():
        on = np.flatnonzero(rho[theta] == distance)
        pos = lines.along(theta, y[on], x[on])
        order = np.argsort(pos, kind="stable")
        on, pos = on[order], pos[order]
        cuts = np.flatnonzero(np.diff(pos) > max_gap) + 1
        for part, p in zip(np.split(on, cuts), np.split(pos, cuts), strict=True):
            if p[-1] - p[0] >= min_length:
                places = sorted(zip(x[part].tolist(), y[part].tolist(), strict=True))
                ends.append((*places[0], *places[-1]))
    return ends


@pytest.mark.parametrize("cut", [1, 1 << 20])
def test_lines_of_an_angle_are_cut_together(monkeypatch, cut):
    """Segments are those found line by line, in the same order, with one look at the pixels an angle."""
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:60, 0:80]
    masks = [np.where((y - m * x) % 14 < 3, 255, 0) * (rng.random((60, 80)) < 0.8) for m in (-0.4, 0.0, 0.2, 3.0)] + [np.zeros((60, 80), int)]
    wanted = [segments_line_by_line(m, 20, n, gap) for m in masks for n, gap in ((10, 1), (15, 4), (40, 10))]
    asked, real = [], lines.along
    monkeypatch.setattr(lines, "along", lambda theta, *more: asked.append(theta) or real(theta, *more))
    monkeypatch.setattr(lines, "CUT", cut)
    assert [list(map(tuple, lines.plane_segments(m, 20, n, gap).tolist())) for m in masks for n, gap in ((10, 1), (15, 4), (40, 10))] == wanted
    assert sum(map(len, wanted)) > 200 and len(asked) <= 180 * 12


def test_files_in_folders(spark):
    """Folders are read some at a time; every file is a row."""
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = fixtures.card_pictures(spark, SMALL).limit(50)
    fixtures.write_png(rows, path, 7)
    assert all(len(os.listdir(f"{path[7:]}/{f}")) <= 7 for f in os.listdir(path[7:]))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    found = images.scan_folders(spark, path, 3)
    assert found.count() == 50 and found.selectExpr("md5(data)").exceptAll(rows.selectExpr("md5(data)")).count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def png(a: np.ndarray, kind: int, filters: list[int], more: bytes = b"") -> bytes:
    """A PNG of RGB, gray or RGBA whose scanlines take the filters in turn."""
    h, w = a.shape[:2]
    rows, n = a.reshape(h, -1).astype(int), a.size // (h * w)
    left, up = np.pad(rows, ((0, 0), (n, 0)))[:, :-n], np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(up, ((0, 0), (n, 0)))[:, :-n]
    near = np.stack([left, up, corner])
    apart = np.abs(near - (left + up - corner))
    by = [0 * rows, left, up, (left + up) // 2, np.take_along_axis(near, apart.argmin(0)[None], 0)[0]]
    use = [filters[y % len(filters)] for y in range(h)]
    raw = b"".join(bytes([f]) + ((rows[y] - by[f][y]) % 256).astype(np.uint8).tobytes() for y, f in enumerate(use))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = zlib.compress(raw)
    parts = [chunk(b"IDAT", data[: len(data) // 2]), chunk(b"IDAT", data[len(data) // 2 :])]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + more + b"".join(parts) + chunk(b"IEND", b"")


def test_small_files_are_read_without_the_image_source(spark):
    """Every file is what the image source says; it reads only what is no small plain PNG, of which none is lost."""
    rng = np.random.default_rng(5)
    rgb, root = rng.integers(0, 256, (6, 5, 3)), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    note = b"tEXta\0b"
    files = {
        "a/plain.png": png(rgb, 2, [0]), "a/sub up.png": png(rgb, 2, [1, 2, 0, 2]), "a/first up%.png": png(rgb, 2, [2, 1]), "a/thin.png": png(rgb[:, :1], 2, [1, 2]),
        "b/paeth.png": png(rgb, 2, [3, 4, 1]), "b/gray.png": png(rgb[..., :1], 0, [1]), "b/rgba.png": png(rng.integers(0, 256, (3, 4, 4)), 6, [0]),
        "b/note.png": png(rgb, 2, [0], struct.pack(">I", 3) + note + struct.pack(">I", zlib.crc32(note))), "c d/large.png": png(rng.integers(0, 256, (200, 150, 3)), 2, [0]), "c d/plain.png": png(rgb, 2, [0]),
    }
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "wb").write(data)
    plain = {n for n, d in files.items() if images.plain_png(d)}
    assert plain == {n for n in files if n[0] == "a" or n in ("c d/plain.png", "c d/large.png")} and images.plain_png(files["a/sub up.png"])[2] == rgb[..., ::-1].astype(np.uint8).tobytes()
    asked, real = [], images.scan_images
    images.scan_images = lambda s, paths, *more: asked.extend(paths) or real(s, paths, *more)
    try:
        found = images.scan_folders(spark, f"file://{root}", 2)
        assert sorted(f.rsplit("/", 1)[1] for f in asked) == ["b", "c d"]
        whole = real(spark, [f"{root}/{f}" for f in ("a", "b", "c d")])
        assert found.columns == whole.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and found.count() == len(files)
        good = png(rgb, 2, [0])
        for broken in (b"junk", good[:-20], good[:45] + b"?" + good[46:], good + b"more", b""):
            assert images.plain_png(broken) is None
        open(f"{root}/a/junk.png", "wb").write(b"junk")
        with pytest.raises(Exception, match="Unable to load image"):
            images.scan_folders(spark, f"file://{root}", 2).count()
    finally:
        images.scan_images = real
