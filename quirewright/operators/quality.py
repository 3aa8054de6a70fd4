"""Quality gates: reports, coverage, completeness, status. All are aggregates per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.cluster import once
from quirewright.functions.text import IMAGE_BASE64, IMAGE_HTML, IMAGE_MARKDOWN, split_lines, strip, unclosed_fence

# Visual types that matter, states that resolve a visual, and the states of coverage.
IMPORTANT = ("code", "terminal", "http", "diff", "configuration", "log", "stack_trace", "table")
RESOLVED = ("resolved_native", "resolved_ocr", "resolved_structured")
COVERAGE = ("transcribed", "native_text_used", "decorative_with_reason", "duplicate_with_reference", "review_required", "failed_with_diagnostic")
COMMENT_MARKER = r"<!--\s*quirewright:"
LOW_CONFIDENCE, SCORE_LOW, SCORE_MEDIUM = 0.7, 0.6, 0.85


def is_visual() -> Column:
    """A visual block."""
    return F.col("type") == "visual"


def is_important() -> Column:
    """A visual of a type that matters, or of no known type."""
    kind = F.coalesce("visual_type", F.lit("unknown"))
    return is_visual() & ((kind == "unknown") | kind.isin(*IMPORTANT))


def is_unresolved() -> Column:
    """An important visual that is neither resolved nor decorative."""
    state = F.coalesce("visual_state", F.lit(""))
    return is_important() & ~state.isin(*RESOLVED, "ignored_decorative")


def is_low_confidence(threshold: float = LOW_CONFIDENCE) -> Column:
    """A transcription below the threshold that asks for review."""
    return F.coalesce((F.col("enrichment.confidence") < threshold) & F.col("enrichment.review_required"), F.lit(False))


def effective_text() -> Column:
    """A block's text, else the selected, else the raw transcription, else empty."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(some("text"), some("enrichment.selected_text"), some("enrichment.raw_text"), F.lit(""))


def effective_language() -> Column:
    """A block's language, else the transcription's, else its visual type, else empty."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(some("language"), some("enrichment.language"), some("visual_type"), F.lit(""))


def order_violations(blocks: DataFrame, arrival: str = "block_id") -> DataFrame:
    """(document_id, violations): blocks whose order does not exceed that of the block that arrived before."""
    before = F.lag("block_order").over(W.partitionBy("document_id").orderBy(arrival))
    return blocks.select("document_id", (F.col("block_order") <= before).alias("bad")).groupBy("document_id").agg(F.count_if("bad").alias("violations"))


def quality_report(blocks: DataFrame, images: Column | None = None) -> DataFrame:
    """One row per document: coverage, resolution, counts, buckets of confidence and the overall score.

    ``images`` is an aggregate telling the number of image references in the rendered text, by default those in the blocks' texts.
    """
    from quirewright.functions.text import count_image_references

    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    texty = F.col("type").isin("paragraph", "heading", "list", "quote") & has_text
    code = F.col("type") == "native_code"
    scored = is_visual() & F.col("enrichment").isNotNull() & (F.coalesce("visual_state", F.lit("")) == "resolved_ocr")
    c = F.col("enrichment.confidence")
    shown = images if images is not None else F.sum(count_image_references(effective_text()))
    report = blocks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        (F.count_if(texty | code) / F.count(F.lit(1))).alias("native_text_coverage"),
        F.count_if(is_important()).alias("important"),
        F.count_if(is_unresolved()).alias("unresolved_visual_count"),
        F.count_if(is_visual() & (F.coalesce("visual_state", F.lit("")) == "resolved_ocr")).alias("ocr_enriched_block_count"),
        F.count_if(scored & (c < SCORE_LOW)).alias("confidence_low"),
        F.count_if(scored & (c >= SCORE_LOW) & (c < SCORE_MEDIUM)).alias("confidence_medium"),
        F.count_if(scored & (c >= SCORE_MEDIUM)).alias("confidence_high"),
        F.count_if(is_visual() & ~scored).alias("confidence_none"),
        F.count_if(is_low_confidence()).alias("low_confidence_blocks"),
        F.coalesce(shown, F.lit(0)).cast("long").alias("markdown_image_count"),
    )
    rate = F.when(F.col("important") > 0, (F.col("important") - F.col("unresolved_visual_count")) / F.col("important")).otherwise(0.0)
    score = 0.5 * F.col("native_text_coverage") + 0.4 * rate + F.when(F.col("markdown_image_count") == 0, 0.1).otherwise(0.0)
    return report.withColumn("important_visual_resolution_rate", rate).withColumn("overall_quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def counts_by_type(blocks: DataFrame) -> DataFrame:
    """(document_id, counts): blocks of each type as a map, in two steps of aggregation."""
    by = blocks.groupBy("document_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))


def coverage_state() -> Column:
    """A visual's recorded state of coverage, else the one its visual state tells; NULL where neither does."""
    vs = F.col("visual_state")
    told = F.when(vs.isin(*RESOLVED), "transcribed").when(vs == "ignored_decorative", "decorative_with_reason").when(vs == "failed", "failed_with_diagnostic")
    return F.coalesce("coverage_state", told)


def coverage_summary(blocks: DataFrame) -> DataFrame:
    """One row per document with visuals: total, one count per state, missing, all_covered."""
    seen = blocks.where(is_visual()).withColumn("__state", coverage_state())
    counts = [F.count_if(F.col("__state") == s).alias(s) for s in COVERAGE]
    out = seen.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_visual_blocks"), *counts, F.count_if(F.col("__state").isNull()).alias("missing"))
    return out.withColumn("all_covered", F.col("missing") == 0)


def uncovered_visuals(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id) of visuals without an entry in the ledger of coverage."""
    return blocks.where(is_visual() & coverage_state().isNull()).select("document_id", "block_id")


def completeness(markdown: DataFrame, blocks: DataFrame, mode: str = "document") -> DataFrame:
    """Six invariants of each rendered document (document_id, markdown), their failures, hash and size."""
    lost = is_visual() & (F.col("visual_state").isNull() | (F.col("coverage_state").isNull() & (F.col("visual_state") != "ignored_decorative")))
    missing = blocks.groupBy("document_id").agg(F.count_if(lost).alias("visuals_missing"))
    md = F.col("markdown")
    out = markdown.join(missing, "document_id", "left").na.fill(0, ["visuals_missing"]).select(
        "document_id", "visuals_missing",
        F.regexp_count(md, F.lit(IMAGE_MARKDOWN)).alias("image_syntax_count"), F.regexp_count(md, F.lit(IMAGE_HTML)).alias("html_img_tag_count"),
        F.regexp_count(md, F.lit(IMAGE_BASE64)).alias("base64_image_uri_count"), unclosed_fence(md).alias("unclosed_fence_count"),
        F.regexp_count(md, F.lit(COMMENT_MARKER)).alias("html_comment_marker_count"), F.sha2(md, 256).alias("markdown_sha256"), F.octet_length(md).alias("markdown_byte_count"),
    )
    names = ["visuals_missing", "image_syntax_count", "html_img_tag_count", "base64_image_uri_count", "unclosed_fence_count"] + (["html_comment_marker_count"] if mode != "strict" else [])
    failed = F.array_compact(F.array(*[F.when(F.col(n) != 0, F.lit(n)) for n in names]))
    return out.withColumn("failed_invariants", failed).withColumn("failed", F.size(failed)).withColumn("passed", 6 - F.size(failed))


def suspicious(blocks: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """(document_id, suspicious): no native paragraph and two or more visuals all left to review, or hardly any text for several pages."""
    state = F.coalesce("visual_state", F.lit(""))
    got = blocks.groupBy("document_id").agg(
        F.count_if((F.col("type") == "paragraph") & (strip(F.coalesce("text", F.lit(""))) != "")).alias("native"),
        F.count_if(is_visual() & state.isin(*RESOLVED)).alias("done"), F.count_if(is_visual() & (state == "failed")).alias("failed"),
        F.count_if(is_visual() & (state != "ignored_decorative")).alias("shown"), F.max("page").alias("pages"),
    )
    broken = (F.col("native") == 0) & (F.col("done") == 0) & (F.col("failed") == 0) & (F.col("shown") >= 2)
    if markdown is None:
        return got.select("document_id", broken.alias("suspicious"))
    sized = got.join(markdown.select("document_id", F.length(strip(F.col("markdown"))).alias("size")), "document_id", "left")
    return sized.select("document_id", (broken | ((F.coalesce("size", F.lit(0)) < 100) & (F.coalesce("pages", F.lit(0)) >= 2))).alias("suspicious"))


def status(report: Column | None = None, *, empty: Column, images: Column, unresolved: Column, errors: Column, incomplete: Column, odd: Column, policy: str = "review") -> Column:
    """Status of a document: failed, rejected, review or accepted, by the first gate that speaks."""
    base = (
        F.when(images > 0, "rejected").when(empty, "failed").when(unresolved > 0, "rejected" if policy == "reject" else "review").when(errors > 0, "rejected").otherwise("accepted")
    )
    return F.when(incomplete | odd, "rejected").otherwise(base)


# ---- pages ------------------------------------------------------------------------------------------------------


def page_flags(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Heuristics over the non-blank lines of each text, by higher-order functions: no row is exploded but by the most frequent line.

    one_char_per_line, extremely_duplicated, only_furniture, chatty, repeated_chars.
    """
    t = F.coalesce(text, F.lit(""))
    base = once(texts.select(key, t.alias("t")), "raw", split_lines(F.col("t")))
    base = once(base, "lines", F.filter(F.transform("raw", strip), lambda x: x != ""))
    n = F.size("lines")
    lines = base.where(n >= 20).select(key, F.explode("lines").alias("line")).groupBy(key, "line").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.max("c").alias("most"))
    short = F.size(F.filter("lines", lambda x: F.length(x) <= 2))
    low, compact = F.lower("t"), F.regexp_replace("t", r"(?U)\s", "")
    chatty = low.contains("the provided image") | low.contains("does not contain any chart") | low.contains("it is a graphic design") | low.contains("cannot be converted into a table")
    flags = base.select(
        key, n.alias("lines"), short.alias("short_lines"), ((n >= 20) & (short / n > 0.8)).alias("one_char_per_line"),
        ((n >= 1) & (n <= 4) & F.array_join("lines", " ").rlike(r"(?i)^(#+\s*)?[\w\s:'’-]{0,80}\s*(page\s*)?\d{0,4}$")).alias("only_furniture"),
        chatty.alias("chatty"), ((F.length(compact) >= 80) & compact.rlike(r"(.)\1{50,}")).alias("repeated_chars"),
    )
    return flags.join(lines, key, "left").withColumn("extremely_duplicated", F.coalesce(F.col("most") / F.col("lines") > 0.6, F.lit(False))).drop("most")


def page_progress(states: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(document_id, verified, failed, processing, pending, last_completed_page) from page states; pages without a state are pending."""
    if pages is not None:
        states = pages.join(states, ["document_id", "page_number"], "left")
    working = F.col("state").isin("extracting", "native_extracted", "visuals_detected", "ocr_processing", "rendered")
    s = F.coalesce("state", F.lit("pending"))
    return states.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages_total"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "failed").alias("failed"),
        F.count_if(F.coalesce(working, F.lit(False))).alias("processing"), F.count_if(~F.coalesce(working, F.lit(False)) & ~s.isin("verified", "failed")).alias("pending"),
        F.max(F.when(s == "verified", F.col("page_number"))).alias("last_completed_page"),
    )
