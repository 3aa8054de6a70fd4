"""Pages of PDFs: blocks of text and images as extracted, to blocks of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.functions.code import code_like
from quirewright.functions.text import collapse, split_lines, strip

DEDUP_LENGTH, MIN_CHARS, DENSITY, IMAGE_SHARE = 20, 20, 0.01, 0.5
# Captions and tokens that tell an image of code.
CAPTION = r"(?i)\b(Figure|Fig\.?|Listing|Code|Example|Screenshot)\b\s*\d"
CODE_TOKENS = r"\b(def |class |import |from |HTTP/|\$ |->|@@|---|\+\+\+|>>>|\.\.\.)"


def box(bbox: Column) -> Column:
    """A box of four numbers; zeros where there is none."""
    return F.when(F.size(bbox) >= 4, F.slice(bbox, 1, 4)).otherwise(F.array(*[F.lit(0.0)] * 4))


def with_code_like(page_blocks: DataFrame) -> DataFrame:
    """page_blocks with ``is_code_like`` and ``language`` derived from the text."""
    c = code_like(F.coalesce("text", F.lit("")))
    return page_blocks.withColumn("is_code_like", c["is_code"]).withColumn("language", c["language"])


def is_ocr_layer(colors: Column) -> Column:
    """Whether all spans of a block are written invisibly, by their colours."""
    return (F.size(colors) > 0) & F.forall(colors, lambda c: c.isin(-1, 0xFFFFFF))


def duplicate_ocr_blocks(page_blocks: DataFrame) -> DataFrame:
    """(document_id, page, pb_id) of OCR-layer blocks whose text equals, contains or lies in a native block's on the same page.

    A theta join within a page: the page is the equi key, containment the residual. Texts of fewer than 20 characters are no evidence.
    """
    rows = page_blocks.where("text is not null").select("document_id", "page", "pb_id", "text", collapse(F.col("text")).alias("norm"), F.coalesce("from_ocr_layer", F.lit(False)).alias("ocr")).distinct()
    native = rows.where(~F.col("ocr") & (F.length("text") >= DEDUP_LENGTH)).select("document_id", "page", F.col("norm").alias("native"))
    layer = rows.where(F.col("ocr") & (F.length("norm") >= DEDUP_LENGTH)).select("document_id", "page", "pb_id", "norm")
    same = F.contains(F.col("native"), F.col("norm")) | F.contains(F.col("norm"), F.col("native"))
    return layer.join(native, (layer.document_id == native.document_id) & (layer.page == native.page) & same, "left_semi").select("document_id", "page", "pb_id")


def without_duplicate_ocr(page_blocks: DataFrame) -> DataFrame:
    """page_blocks without the OCR-layer blocks that a native block on their page covers."""
    return page_blocks.join(duplicate_ocr_blocks(page_blocks).select("pb_id").distinct(), "pb_id", "left_anti")


def page_columns(page_blocks: DataFrame) -> DataFrame:
    """(document_id, page, columns): two if blocks stand left and right of the middle and overlap in height by 30 %, else one."""
    rows = page_blocks.where(F.size("bbox") >= 4).select("document_id", "page", "pb_id", "bbox", "page_width").distinct()
    b = F.col("bbox")
    center, mid = (b[0] + b[2]) / 2, F.col("page_width") / 2
    left, right = center < mid * 0.8, center > mid * 1.2
    g = rows.groupBy("document_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_width").alias("w"), F.min(F.when(left, b[1])).alias("l0"), F.max(F.when(left, b[3])).alias("l1"),
        F.min(F.when(right, b[1])).alias("r0"), F.max(F.when(right, b[3])).alias("r1"),
    )
    overlap = F.least("l1", "r1") - F.greatest("l0", "r0")
    height = F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0"))
    both = F.col("l0").isNotNull() & F.col("r0").isNotNull()
    two = both & (F.col("n") >= 4) & (F.col("w") > 0) & (height > 0) & (overlap > height * 0.3)
    return g.select("document_id", "page", F.when(two, 2).otherwise(1).alias("columns"))


def image_area_ratio(boxes: Column, width: Column, height: Column) -> Column:
    """Share of the page that images cover, 1 at most."""
    area = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]))
    page = width * height
    return F.when(page > 0, F.least(F.lit(1.0), area / page)).otherwise(0.0)


def scanned_pages(page_blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(document_id, page, chars, density, image_ratio, scanned). ``images``: document_id, page, boxes."""
    rows = page_blocks.select("document_id", "page", "pb_id", F.length(strip(F.coalesce("text", F.lit("")))).alias("n"), "page_width", "page_height").distinct()
    g = rows.groupBy("document_id", "page").agg(F.sum("n").alias("chars"), F.max("page_width").alias("w"), F.max("page_height").alias("h"))
    if images is not None:
        g = g.join(images, ["document_id", "page"], "left").withColumn("image_ratio", F.coalesce(image_area_ratio(F.col("boxes"), F.col("w"), F.col("h")), F.lit(0.0)))
    else:
        g = g.withColumn("image_ratio", F.lit(0.0))
    area = F.col("w") * F.col("h")
    density = F.when(area > 0, F.col("chars") / area)
    few = F.col("chars") < MIN_CHARS
    scanned = F.when(area > 0, (few & (density < DENSITY)) | ((F.col("chars") < MIN_CHARS * 5) & (F.col("image_ratio") >= IMAGE_SHARE))).otherwise(few)
    return g.select("document_id", "page", "chars", density.alias("density"), "image_ratio", scanned.alias("scanned"))


def block_type(text: Column, is_code: Column) -> Column:
    """native_code, heading (one short line without a closing mark) or paragraph."""
    t = strip(text)
    title = (F.size(split_lines(t)) == 1) & (F.length(t) < 120) & ~t.rlike(r"[.!?:]$")
    return F.when(is_code, "native_code").when(title, "heading").otherwise("paragraph")


def page_blocks_to_blocks(page_blocks: DataFrame) -> DataFrame:
    """Blocks of the document from page blocks, in reading order: order is page index x 10000 + place on the page.

    Numbering is by window within (document, page), a group that a page bounds.
    """
    from pyspark.sql import Window as W

    rows = page_blocks.where(strip(F.coalesce("text", F.lit(""))) != "").select("document_id", "page", "pb_id", "text", "bbox", F.coalesce("is_code_like", F.lit(False)).alias("code"), "language").distinct()
    b = box(F.col("bbox"))
    at = W.partitionBy("document_id", "page").orderBy(b[1], b[0], "pb_id")
    kind = block_type(F.col("text"), F.col("code"))
    order = (F.col("page") - 1) * 10000 + F.row_number().over(at) - 1
    made = rows.withColumn("block_order", order).withColumn("type", kind)
    return made.select(
        "document_id", "block_order", F.format_string("b_%06d", F.col("block_order") + 1).alias("block_id"), "type", F.when(F.col("code"), F.col("text")).otherwise(strip(F.col("text"))).alias("text"),
        F.when(F.col("code"), F.col("language")).alias("language"), F.when(F.col("type") == "heading", 2).alias("heading_level"), "page", "pb_id",
    )


def heading_level(size: Column, body: Column) -> Column:
    """Level by the ratio of a line's font size to the body's; NULL for body text."""
    r = size / body
    return F.when(r >= 1.6, 1).when(r >= 1.3, 2).when(r >= 1.15, 3)


def image_class(bbox: Column, pixels: Column, page_area: Column, page_text: Column, page_has_code: Column) -> Column:
    """State of an embedded image: decorative, described as text, or a candidate for recognition, by the first rule that fits."""
    area = F.greatest(F.lit(0.0), bbox[2] - bbox[0]) * F.greatest(F.lit(0.0), bbox[3] - bbox[1])
    ratio = F.when(page_area > 0, area / page_area).otherwise(0.0)
    bare = ~page_text.rlike(CAPTION) & ~page_text.rlike(CODE_TOKENS)
    plain = bare & ~F.coalesce(page_has_code, F.lit(False))
    return (
        F.when((ratio >= 0.7) & plain, "ignored_decorative")
        .when((ratio >= 0.4) & plain & (F.length(page_text) >= 200), "described_as_text")
        .when((F.coalesce(pixels, F.lit(0)) >= 8_000_000) & bare & (ratio >= 0.5), "ignored_decorative")
        .when((ratio >= 0.5) & bare & (F.length(page_text) < 100), "ignored_decorative")
        .otherwise("ocr_candidate")
    )
