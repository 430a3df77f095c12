"""Composite plans: region isolation, deskewing, binarisation, full preprocessing, recognition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.pictures import by_shape, map_rows, packed, pictures_of, unpacked
from inkgrid.functions.tables import by_image, written
from inkgrid.operators import denoise, geometry, lines, neighborhood, ocr, pixels, recognize, regions, stats
from inkgrid.sources import images as rasters

KEY = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Settings:
    """Kernel sizes and limits; the defaults suit photographs of some megapixels. Without ``background`` its kernel follows each picture's size."""

    blur: int = 51
    close: int = 35
    open: int = 20
    margin: int = 5
    background: int | None = None
    tiles: int = 8
    nlm_h: float = 7.0
    template: int = 7
    search: int = 21
    votes: int = 100
    min_length: int = 100
    max_gap: int = 10
    blur_threshold: float = 100.0


def isolated(bgr: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Of a stack: each cut to the largest region that is bright and not wood, closed and opened; or whole."""
    bright = neighborhood.blurred_plane(pixels.luma_plane(bgr), s.blur)
    lit = (bright > stats.thresholds(bright)[:, None, None]) & ~pixels.in_range_plane(bgr, *pixels.WOOD)
    masks = neighborhood.opened_plane(neighborhood.closed_plane(np.where(lit, np.uint8(255), np.uint8(0)), s.close), s.open)
    return [pixels.cut_plane(p, box, s.margin) for p, box in zip(bgr, regions.largest_boxes(masks), strict=True)]


def straightened(pictures: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Of a stack, gray or colour: each turned by its skew on a grown canvas: edges, thickened along lines, to segments to a median angle."""
    gray = (pixels.luma_plane(pictures) if pictures.ndim == 4 else pictures).astype(np.int32)
    if not lines.may_have_lines(*gray.shape[1:], s.votes):
        return list(pictures)
    thick = neighborhood.dilated_plane(regions.strong_planes(neighborhood.thinned_plane(gray), 50, 150), 15, 3)
    return [turned(p, lines.median_angle(lines.plane_segments(t, s.votes, s.min_length, s.max_gap))) for p, t in zip(pictures, thick, strict=True)]


def turned(picture: np.ndarray, angle: float | None) -> np.ndarray:
    """Gray or colour, turned on a grown canvas."""
    if angle is None:
        return picture
    planes = geometry.turned_planes([picture] if picture.ndim == 2 else [picture[..., i] for i in range(picture.shape[2])], *geometry.canvas(*picture.shape[:2], angle))
    return planes[0] if picture.ndim == 2 else np.stack(planes, axis=-1)


def binarized(gray: np.ndarray, s: Settings) -> np.ndarray:
    """Of a stack: closing as background, division, histogram threshold, small opening."""
    flat = pixels.divided_plane(gray, neighborhood.background_plane(gray.astype(np.int32), s.background))
    return neighborhood.opened_plane(np.where(flat > stats.thresholds(flat)[:, None, None], np.uint8(255), np.uint8(0)), 2)


def cleaned(pictures: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """Isolated, straightened, gray, with contrast, denoised; pictures of one shape together at each step."""
    straight = by_shape(by_shape(pictures, lambda p: isolated(p, s)), lambda p: straightened(p, s))
    contrast = by_shape(straight, lambda p: stats.contrast_plane(pixels.luma_plane(p), tiles=s.tiles).astype(np.uint8), s.tiles * s.tiles * 256)
    return by_shape(contrast, lambda p: denoise.denoised_plane(p, s.nlm_h, s.template, s.search).astype(np.int32))


def isolate_document(bgr: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each image cut to its largest bright region, or whole."""
    return isolate_pictures(packed(bgr), s)


def isolate_pictures(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``isolate_document`` of picture rows; nothing is shuffled."""
    return unpacked(pictures_of(images, lambda a: isolated(a, s)))


def correct_rotation(image: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Images, gray or colour, turned by their skew on a grown canvas; those without a correction stay as they are."""
    found = rotate_pictures(packed(image), s)
    return found.select(*KEY, F.col("b").alias("v")) if "v" in image.columns else found


def rotate_pictures(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``correct_rotation`` of picture rows to pixel rows b, g, r; nothing is shuffled."""
    return unpacked(pictures_of(images, lambda a: straightened(a, s)))


def adaptive_threshold(gray: DataFrame, background: int | None = None) -> DataFrame:
    """Closing as background, division, histogram threshold, small opening."""
    s = Settings(background=background)
    return unpacked(pictures_of(packed(gray), lambda a: binarized(a, s))).select(*KEY, F.col("b").alias("v"))


class Preprocessed(NamedTuple):
    processed: DataFrame
    binarized: DataFrame
    ocr_ready: DataFrame
    quality: DataFrame


def preprocess_pictures(images: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ("image_id",), tolerant: bool = False) -> DataFrame:
    """Picture rows to one row an image: the columns ``keep``, processed (gray), binarized, blur_score, is_blurry. All steps in one pass; nothing is shuffled."""

    return map_rows(images, lambda pictures: preprocessed_each(pictures, s), ("processed", "binarized"), "blur_score double, is_blurry boolean", keep, tolerant)


def preprocessed_each(pictures: list[np.ndarray], s: Settings = Settings()) -> list[dict[str, object]]:
    """Of each picture: processed (gray), binarized, blur_score, is_blurry."""
    clean = cleaned([in_colour(p) for p in pictures], s)
    binary, sharp = by_shape(clean, lambda p: binarized(p, s)), by_shape(clean, lambda p: stats.sharpness_each(p, s.blur_threshold))
    return [{"processed": c, "binarized": b, "blur_score": score, "is_blurry": blurry} for c, b, (score, blurry) in zip(clean, binary, sharp, strict=True)]


def in_colour(picture: np.ndarray) -> np.ndarray:
    """A picture of one channel gets three equal ones."""
    return picture if picture.ndim == 3 else np.stack([picture] * 3, axis=-1)


def preprocess(bgr: DataFrame, s: Settings = Settings()) -> Preprocessed:
    """Denoised gray, binarised, recogniser-ready BGR, and quality, from pixel rows: one exchange, to picture rows, written once."""
    return preprocessed_rows(packed(bgr), s)


def preprocessed_rows(images: DataFrame, s: Settings = Settings()) -> Preprocessed:
    """``preprocess`` of picture rows: written once, nothing is shuffled."""
    table = written(preprocess_pictures(images, s), "preprocessed")
    gray = lambda name: unpacked(table, name).select(*KEY, F.col("b").alias("v"))
    quality = table.select("image_id", "blur_score", "is_blurry", F.lit(True).alias("preprocessing_applied"))
    return Preprocessed(gray("processed"), gray("binarized"), unpacked(table, "processed"), quality)


class Recognised(NamedTuple):
    blocks: DataFrame
    documents: DataFrame
    quality: DataFrame | None
    #: image_id, stage, message, where failures are asked for.
    failures: DataFrame | None = None


def raw_quality(bgr: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Quality of images as they are."""
    return stats.blur_score(by_image(pixels.to_gray(bgr)), s.blur_threshold).withColumn("preprocessing_applied", F.lit(False))


def named(quality: DataFrame, names: DataFrame) -> DataFrame:
    """Quality by document: the document of an image is its path (``names`` has image_id and path)."""
    return quality.join(names.select("image_id", F.col("path").alias("document_name")), "image_id").select("document_name", "blur_score", "is_blurry", "preprocessing_applied")


def ocr_results(raw: DataFrame, quality: DataFrame | None = None, drop_blurry: bool = False) -> Recognised:
    """Blocks and documents of recognition output. Blurry images are annotated; they go only with ``drop_blurry``."""
    if quality is not None and drop_blurry:
        raw = raw.join(quality.where("is_blurry"), "document_name", "left_anti")
    return Recognised(ocr.ocr_blocks(raw), ocr.ocr_documents(raw), quality)


def raw_quality_pictures(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Quality of images as they are, from picture rows; nothing is shuffled."""

    def change(pictures: list[np.ndarray]) -> list[dict[str, object]]:
        sharp = by_shape([in_colour(p) for p in pictures], lambda p: stats.sharpness_each(pixels.luma_plane(p), s.blur_threshold))
        return [{"blur_score": score, "is_blurry": blurry} for score, blurry in sharp]

    return map_rows(images, change, (), "blur_score double, is_blurry boolean").withColumn("preprocessing_applied", F.lit(False))


def ocr_pipeline(
    images: DataFrame,
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    preprocess_images: bool = False,
    check_quality: bool = True,
    drop_blurry: bool = False,
    s: Settings = Settings(),
    on_invalid: str = "fail",
) -> Recognised:
    """Images (as ``scan_images`` gives them) through a recogniser to blocks, documents and quality.

    With ``preprocess_images`` the recogniser gets the preprocessed pictures, and the quality is that of
    the preprocessed gray image and is always there; else it gets the images as they are, and the
    quality is that of the plain gray image, and only with ``check_quality``.

    An image that is no picture, or that a step or the recogniser cannot do, ends the job (``fail``), is left out
    (``drop``), or is left out and listed in ``failures`` (``quarantine``: image_id, stage, message); a document without
    blocks is left of those that the recogniser could not do.
    """
    good, failures = rasters.readable_images(images, on_invalid)
    tolerant, lost, quality = on_invalid != "fail", [], None
    told = lambda df, stage: df.where("failure is not null").select("image_id", F.lit(stage).alias("stage"), F.col("failure").alias("message"))
    if preprocess_images:
        found = written(preprocess_pictures(good, s, ("image_id", "path"), tolerant), "preprocessed")
        if tolerant:
            lost.append(told(found, "preprocess"))
            found = found.where("failure is null").drop("failure")
        quality = found.select("image_id", "blur_score", "is_blurry", F.lit(True).alias("preprocessing_applied"))
        ready = map_rows(found.select("image_id", "path", "processed.*"), lambda p: [{"ready": in_colour(a)} for a in p], ("ready",), keep=("image_id", "path"))
        raw = recognize.recognize_batch(ready.select("image_id", "path", "ready.*"), factory, tolerant).withColumn("variant", F.lit("preprocessed"))
    else:
        raw = recognize.recognize_batch(good, factory, tolerant).withColumn("variant", F.coalesce("variant", F.lit("raw")))
        if check_quality:
            quality = raw_quality_pictures(good, s)
    raw = written(raw, "recognised")
    if tolerant:
        names = images.select("image_id", "path").distinct()
        lost.append(told(raw.where("failure is not null").join(names, F.col("document_name") == F.col("path")), "recognise"))
        raw = raw.drop("failure")
    results = ocr_results(raw, None if quality is None else named(quality, good), drop_blurry)
    return results if failures is None else results._replace(failures=reduce(DataFrame.unionByName, [failures, *lost]))
