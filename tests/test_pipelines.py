"""From image files to documents, awkward tables, and every registered query against its SQL."""

from __future__ import annotations

import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgrid import catalog, fixtures
from inkgrid.functions.scalar import ellipse_half_widths
from inkgrid.operators import denoise, geometry, lines, neighborhood, pixels, regions, stats
from inkgrid.plans import pipelines
from inkgrid.sources import images

SMALL = "/root/testdata/sf0.001"
LIGHT = pipelines.Settings(blur=5, close=5, open=4, margin=1, template=3, search=5, votes=50, min_length=40)
BGR = "image_id long, y int, x int, b int, g int, r int"


def page(slope: float, height: int = 72, width: int = 96) -> np.ndarray:
    """A bright page with slanted lines on brown wood, as B, G, R."""
    y, x = np.mgrid[0:height, 0:width]
    out = np.empty((height, width, 3), np.uint8)
    out[:] = (60, 110, 150)
    inside = (y > 3) & (y < height - 4) & (x > 3) & (x < width - 4)
    out[inside] = (230, 232, 235)
    out[inside & ((y - slope * x) % 16 < 2)] = (40, 40, 40)
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, 72, 96, 3, page(slope).tobytes()) for i, slope in enumerate((-0.12, 0.0, 0.15))]
    fixtures.write_png(spark.createDataFrame(rows, "image_id long, height int, width int, n_channels int, data binary"), path)
    return images.scan_images(spark, path)


@pytest.fixture(scope="module")
def factory():
    """A recogniser that tells what it sees; nested, so that it travels to the workers by value."""

    def build():
        def run(batch):
            rows = list(zip(batch["height"], batch["width"], batch["data"], strict=True))
            box = [[[[0.0, 0.0], [float(w), 0.0], [float(w), float(h)], [0.0, float(h)]]] for h, w, _ in rows]
            return pd.DataFrame({"document_name": batch["path"], "variant": "raw", "page": 0, "rec_texts": [[f"{h}x{w}:{len(set(d))}"] for h, w, d in rows], "rec_scores": [[0.5]] * len(batch), "dt_polys": box})

        return run

    return build


def test_scanned_images_to_regions_and_rotation(scanned):
    """Ids of scanned images are strings: regions, skew and colour rotation work on them all the same."""
    bgr = images.raster_to_pixels(scanned)
    assert dict(bgr.dtypes)["image_id"] == "string"
    cut = pipelines.isolate_document(bgr, LIGHT)
    sizes = {r["image_id"][-5]: (r["height"], r["width"]) for r in stats.extents(cut).collect()}
    assert all(50 < h < 70 and 70 < w < 94 for h, w in sizes.values()) and len(sizes) == 3
    skew = {r["image_id"][-5]: r for r in pipelines.lines.skew_angle(lines.line_segments(neighborhood.dilate(lines.canny_edges(pixels.to_gray(cut)), 15, 3), 50, 40, 10), cut).collect()}
    assert abs(skew["0"]["median_angle"] - np.degrees(np.arctan(-0.12))) < 1.5 and skew["2"]["applied"] and not skew["1"]["applied"]
    turned = pipelines.correct_rotation(cut, LIGHT)
    assert turned.columns == ["image_id", "y", "x", "b", "g", "r"]
    grown = {r["image_id"][-5]: (r["height"], r["width"]) for r in stats.extents(turned).collect()}
    assert grown["1"] == sizes["1"] and grown["0"][0] > sizes["0"][0]


def test_pipeline_from_files(scanned, factory):
    """The recogniser sees preprocessed pictures only if asked to; documents are named by their paths."""
    paths = {r[0] for r in scanned.select("path").collect()}
    plain = pipelines.ocr_pipeline(scanned, factory, s=LIGHT)
    blocks = {r["document_name"]: r for r in plain.blocks.collect()}
    assert set(blocks) == paths and {r["text"].split(":")[0] for r in blocks.values()} == {"72x96"} and all(r["variant"] == "raw" for r in blocks.values())
    assert {(r["document_name"], r["preprocessing_applied"]) for r in plain.quality.collect()} == {(p, False) for p in paths}
    assert pipelines.ocr_pipeline(scanned, factory, check_quality=False).quality is None
    ready = pipelines.ocr_pipeline(scanned, factory, preprocess_images=True, check_quality=False, s=LIGHT)
    seen = {r["document_name"]: r["text"].split(":")[0] for r in ready.blocks.collect()}
    assert set(seen) == paths and "72x96" not in seen.values()
    assert {(r["document_name"], r["preprocessing_applied"]) for r in ready.quality.collect()} == {(p, True) for p in paths}
    assert {r["variant"] for r in ready.documents.collect()} == {"preprocessed"}


def test_failures_beside_results(spark, factory):
    """A truncated file, an empty picture, null bytes, and a picture that the recogniser cannot do: listed, the others done."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(f"good{i}", 72, 96, 3, page(0.1 * i).tobytes()) for i in range(2)] + [("cut", 72, 96, 3, page(0).tobytes())]
    fixtures.write_png(spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary"), path)
    with open(f"{path}/cut.png", "r+b") as f:
        f.truncate(40)
    found = spark.read.format("image").load(path).select("image.*")
    scanned = found.select(F.col("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    more = spark.createDataFrame([("empty", "empty", 0, 0, 3, b""), ("null", "null", 4, 4, 3, None), ("bad", "bad", 5, 7, 3, bytes(105))], scanned.schema)
    every = scanned.unionByName(more)

    def picky():
        inner = factory()

        def run(batch):
            if (batch["path"] == "bad").any():
                raise ValueError("cannot read this")
            return inner(batch)

        return run

    for prepared in (False, True):
        result = pipelines.ocr_pipeline(every, picky, preprocess_images=prepared, s=LIGHT, on_invalid="quarantine")
        lost = sorted((r["image_id"].rsplit("/", 1)[-1], r["stage"]) for r in result.failures.collect())
        assert lost == [("bad", "recognise"), ("cut.png", "scan"), ("empty", "scan"), ("null", "scan")]
        assert "cannot read this" in result.failures.where("stage = 'recognise'").first()["message"]
        assert sorted(r["document_name"].rsplit("/", 1)[-1] for r in result.blocks.collect()) == ["good0.png", "good1.png"]
        assert {r["document_name"].rsplit("/", 1)[-1]: r["total_blocks"] for r in result.documents.collect()} == {"good0.png": 1, "good1.png": 1, "bad": 0}
    dropped = pipelines.ocr_pipeline(every, picky, s=LIGHT, on_invalid="drop")
    assert dropped.failures is None and dropped.blocks.count() == 2
    with pytest.raises(Exception, match="Unable to load image"):
        pipelines.ocr_pipeline(every, picky, s=LIGHT)
    rows = spark.createDataFrame([("a", 2, 2, 3, bytes(12)), ("odd", 3, 2, 3, bytes(12))], "image_id string, height int, width int, n_channels int, data binary")
    assert {r["image_id"]: r["failure"] is None for r in pipelines.preprocess_pictures(rows, LIGHT, tolerant=True).collect()} == {"a": True, "odd": False}


def test_channels_turn_as_gray_does(spark):
    rng = np.random.default_rng(4)
    rows = [(7, y, x, *map(int, rng.integers(0, 256, 3))) for y in range(9) for x in range(11)]
    bgr = spark.createDataFrame(rows, BGR)
    skew = spark.createDataFrame([(7, 1, -12.0, True)], "image_id long, n_lines long, median_angle double, applied boolean")
    g = geometry.rotation_geometry(skew, stats.extents(bgr))
    turned = geometry.rotate_gather(bgr, g)
    for c in "bgr":
        one = geometry.rotate_gather(bgr.select("image_id", "y", "x", F.col(c).alias("v")), g)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, turned.select("image_id", "y", "x", c).collect()))


def test_denoising_by_channel(spark):
    rng = np.random.default_rng(8)
    rows = [(1, y, x, *map(int, rng.integers(0, 256, 3))) for y in range(6) for x in range(7)]
    bgr = spark.createDataFrame(rows, BGR)
    found = denoise.nlm_denoise_bgr(bgr, 10.0, 3, 5)
    for c in "bgr":
        one = denoise.nlm_denoise(bgr.select("image_id", "y", "x", F.col(c).alias("v")), 10.0, 3, 5)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, found.select("image_id", "y", "x", c).collect()))


def test_clahe_by_definition(spark):
    """Eight by eight tiles of sizes that do not divide, of one line, and of one pixel."""
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, s) for s in ((13, 21), (1, 5), (3, 1), (1, 1))]
    rows = [(i, y, x, int(v)) for i, a in enumerate(pictures) for (y, x), v in np.ndenumerate(a)]
    got = {}
    for i, y, x, v in stats.clahe_apply(spark.createDataFrame(rows, "image_id long, y int, x int, v int")).collect():
        got[i, y, x] = v

    def at(k, n):
        return 0 if n == 1 else (k % (2 * n - 2)) if k % (2 * n - 2) < n else 2 * n - 2 - k % (2 * n - 2)

    for i, a in enumerate(pictures):
        h, w = a.shape
        th, tw = -(-h // 8), -(-w // 8)
        lut = {}
        for ty in range(8):
            for tx in range(8):
                hist = [0] * 256
                for y in range(ty * th, (ty + 1) * th):
                    for x in range(tx * tw, (tx + 1) * tw):
                        hist[a[at(y, h), at(x, w)]] += 1
                limit = max(1, int(1.5 * th * tw / 256))
                over = sum(max(c - limit, 0) for c in hist)
                hist = [min(c, limit) + over // 256 for c in hist]
                left = over % 256
                for k in range(0, 256, max(256 // left, 1)) if left else []:
                    if left:
                        hist[k] += 1
                        left -= 1
                total = np.cumsum(hist)
                lut[ty, tx] = [min(255, int(np.rint(t * 255 / (th * tw)))) for t in total]
        for (y, x), v in np.ndenumerate(a):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = int(np.floor(fy)), int(np.floor(fx))
            p = [[lut[min(max(y1 + j, 0), 7), min(max(x1 + k, 0), 7)][v] for k in (0, 1)] for j in (0, 1)]
            wy, wx = fy - y1, fx - x1
            want = np.rint((p[0][0] * (1 - wx) + p[0][1] * wx) * (1 - wy) + (p[1][0] * (1 - wx) + p[1][1] * wx) * wy)
            assert got[i, y, x] == want


def test_background_kernel_follows_the_picture(spark):
    assert [neighborhood.background_kernel(*s) for s in ((10, 20), (600, 300), (700, 520), (100, 799))] == [51, 61, 71, 79]
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 256, (4, 620)), rng.integers(0, 256, (5, 9))
    rows = [(i, y, x, int(v)) for i, p in enumerate((a, b)) for (y, x), v in np.ndenumerate(p)]
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in neighborhood.morph_close_ellipse(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), None).collect()}
    for i, (p, k) in enumerate(((a, 63), (b, 51))):
        for pick in (max, min):
            out = np.zeros_like(p)
            for (y, x), _ in np.ndenumerate(p):
                out[y, x] = pick(p[y + d - k // 2, max(0, x - h) : x + h + 1].max() if pick is max else p[y + d - k // 2, max(0, x - h) : x + h + 1].min() for d, h in enumerate(ellipse_half_widths(k)) if 0 <= y + d - k // 2 < p.shape[0])
            p = out
        assert all(got[i, y, x] == v for (y, x), v in np.ndenumerate(p))


def test_empty_null_and_broken_pictures(spark):
    """Empty tables give empty tables, a null value counts as 0, a missing or repeated pixel is an error."""
    gray, colour = spark.createDataFrame([], "image_id string, y int, x int, v int"), spark.createDataFrame([], "image_id string, y int, x int, b int, g int, r int")
    for found in (stats.clahe_apply(gray), stats.clahe_lut(gray), denoise.nlm_denoise(gray), neighborhood.gaussian_blur(gray), neighborhood.morph_close(gray), lines.hough_votes(gray), lines.line_segments(gray), regions.connected_components(gray), images.pack_raster(colour), denoise.nlm_denoise_bgr(colour), pipelines.isolate_document(colour, LIGHT), pipelines.correct_rotation(colour, LIGHT)):
        assert found.count() == 0
    rows = [("a", y, x, None if (y, x) == (1, 1) else 9) for y in range(3) for x in range(3)]
    table = spark.createDataFrame(rows, "image_id string, y int, x int, v int")
    assert {(r["y"], r["x"]) for r in neighborhood.erode(table, 2, 2).collect() if r["v"] == 0} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    for broken in (table.where("not (y = 0 and x = 1)"), table.union(table.limit(1))):
        with pytest.raises(Exception, match="missing or repeated pixels"):
            neighborhood.erode(broken, 2, 2).collect()


def test_carried_columns_stay(spark):
    rows = [(1, y, x, y * x, f"{y},{x}") for y in range(3) for x in range(4)]
    out = neighborhood.dilate(spark.createDataFrame(rows, "image_id long, y int, x int, v int, name string"), 3, 3)
    assert all(r["name"] == f"{r['y']},{r['x']}" for r in out.collect()) and out.count() == 12


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    a = catalog.queries()[name](spark, SMALL).toPandas()
    b = con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = a[sorted(a.columns)], b[sorted(a.columns)]
    if len(a) > 5000:  # pixels: whole numbers, compared as sorted arrays
        one, two = (np.array([df[c].to_numpy(np.float64) for c in df.columns]) for df in (a, b))
        assert one.shape == two.shape and np.array_equal(one[:, np.lexsort(one)], two[:, np.lexsort(two)])
        return
    norm = lambda df: sorted(str(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (float, int, np.number, np.bool_)) else str(v) for v in r)) for r in df.astype(object).itertuples(index=False))
    assert norm(a) == norm(b)


def test_preprocessing_shuffles_pixels_once(spark):
    """Pixel rows meet once, as whole pictures; picture rows never."""
    found = pipelines.preprocess(spark.createDataFrame([("a", y, x, 9, 9, 9) for y in range(6) for x in range(6)], BGR.replace("long", "string")), LIGHT)
    for df in found:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a", 6, 6, 3, bytes(108)), ("gray", 2, 3, 1, bytes(range(6)))], "image_id string, height int, width int, n_channels int, data binary")
    ready = pipelines.preprocess_pictures(rows, LIGHT)
    assert "Exchange" not in ready._jdf.queryExecution().executedPlan().toString()
    assert {r["image_id"]: r["processed"]["n_channels"] for r in ready.collect()} == {"a": 1, "gray": 1}
