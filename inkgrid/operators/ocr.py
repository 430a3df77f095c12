"""Recognition output as tables: blocks, documents, summaries, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")


def _lists() -> tuple[Column, Column, Column]:
    """The three parallel lists; a missing one counts as empty."""
    empty = {"rec_texts": "array<string>", "rec_scores": "array<double>", "dt_polys": "array<array<array<double>>>"}
    return tuple(F.coalesce(F.col(c), F.array().cast(t)) for c, t in empty.items())


def _zipped() -> Column:
    """Blocks as structs t, s, p: the lists are zipped up to the shortest."""
    texts, scores, polys = _lists()
    return F.slice(F.arrays_zip(texts.alias("t"), scores.alias("s"), polys.alias("p")), F.lit(1), F.least(F.size(texts), F.size(scores), F.size(polys)))


def _fields() -> tuple[Column, Column, Column]:
    """Text, confidence and corners of a block ``z``."""
    p = F.col("z.p")
    corner = lambda i: F.when(F.size(p) >= 4, F.get(p, F.lit(i))).otherwise(F.raise_error(F.lit("a text polygon needs four points")))
    return F.col("z.t").alias("text"), F.col("z.s").cast("double").alias("confidence"), F.struct(*[corner(i).alias(n) for i, n in enumerate(CORNERS)]).alias("bbox")


def ocr_blocks(raw: DataFrame, page: int | None = 0) -> DataFrame:
    """Blocks in input order: the lists are zipped up to the shortest. Only ``page`` is read; None reads all.

    A polygon of fewer than four points is an error; points beyond the fourth are dropped.
    """
    if page is not None:
        raw = raw.where(F.col("page") == page)
    return raw.select("document_name", "variant", F.posexplode(_zipped()).alias("block_idx", "z")).select("document_name", "variant", "block_idx", *_fields())


def _by_document(raw: DataFrame, page: int | None, *found: Column) -> DataFrame:
    """Aggregates of the blocks ``block_idx, t, s, p`` of every document and variant, those without blocks too: one scan, one exchange."""
    wanted = F.lit(True) if page is None else F.col("page") == page
    block = raw.select("document_name", "variant", F.posexplode_outer(F.when(wanted, _zipped())).alias("block_idx", "z"))
    return block.select("document_name", "variant", "block_idx", "z").groupBy("document_name", "variant").agg(F.count("block_idx").cast("int").alias("total_blocks"), *found)


def ocr_documents(raw: DataFrame, page: int | None = 0) -> DataFrame:
    """One record per document and variant, without blocks too: total_blocks, results in block order."""
    held = F.when(F.col("block_idx").isNotNull(), F.struct("block_idx", *_fields()))
    item = lambda b: F.struct(b["text"].alias("text"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox"))
    return _by_document(raw, page, F.transform(F.array_sort(F.collect_list(held)), item).alias("results"))


def alignment_audit(raw: DataFrame, page: int = 0) -> DataFrame:
    """Lengths of the parallel lists, the blocks they give, and whether they disagree."""
    n = [F.size(c) for c in _lists()]
    return raw.where(F.col("page") == page).select("document_name", "variant", n[0].alias("n_texts"), n[1].alias("n_scores"), n[2].alias("n_polys"), F.least(*n).alias("n_blocks"), (F.greatest(*n) != F.least(*n)).alias("misaligned"))


def confidence_summary(raw: DataFrame, page: int = 0) -> DataFrame:
    """Blocks and mean confidence (9 digits; null without blocks) of every document and variant."""
    return _by_document(raw, page, F.round(F.avg(F.col("z.s").cast("double")), 9).alias("mean_confidence"))


def variant_comparison(raw: DataFrame, page: int = 0) -> DataFrame:
    """Blocks and mean confidence of the two variants side by side."""
    both = confidence_summary(raw, page).groupBy("document_name").pivot("variant", ["preprocessed", "raw"]).agg(F.first("total_blocks").alias("blocks"), F.first("mean_confidence").alias("confidence"))
    return both.select("document_name", *[F.col(f"{v}_{c}").alias(f"{v}_{c}") for v in ("preprocessed", "raw") for c in ("blocks", "confidence")])


def block_listing(raw: DataFrame, page: int = 0) -> DataFrame:
    """Numbered lines, as a person reads them."""
    number = F.col("block_idx") + 1
    return ocr_blocks(raw, page).select("document_name", "variant", number.alias("number"), F.format_string('[%d] "%s"  (conf: %.2f)', number, "text", "confidence").alias("line"))


def with_quality(documents: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality attached to document records; documents without one keep nulls."""
    return documents.join(quality, "document_name", "left")


def overlay_annotations(raw: DataFrame, page: int = 0, coord_space: str = "original") -> DataFrame:
    """What a picture would show, as a table: outline corners cut to whole pixels, label and its place, colours and sizes.

    ``coord_space`` says which image the coordinates belong to: ``original`` or ``preprocessed``.
    """
    blocks = ocr_blocks(raw, page)
    points = [F.get(F.col(f"bbox.{c}"), F.lit(i)).cast("int").alias(f"{a}{k}") for k, c in enumerate(CORNERS, 1) for i, a in enumerate("xy")]
    x, y = (F.get(F.col("bbox.top_left"), F.lit(i)).cast("int") for i in (0, 1))
    drawn = {"poly_bgr": "0,255,0", "poly_thickness": 2, "label_bgr": "0,0,255", "label_scale": 0.5, "label_thickness": 1, "coord_space": coord_space}
    return blocks.select("document_name", "variant", "block_idx", *points, F.col("text").alias("label"), x.alias("label_x"), F.greatest(y - 5, F.lit(10)).alias("label_y"), *[F.lit(v).alias(k) for k, v in drawn.items()])
