"""Batches: what to process, what a run did, how far pages are, and how fast it goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.functions.text import IMAGE_MARKDOWN, unclosed_fence
from quirewright.streaming.incremental import FINISHED, plain_hash


def latest_state(batch_state: DataFrame) -> DataFrame:
    """The newest row of each source by capture, then attempts: an upsert by key over an append-only log."""
    cols = [c for c in batch_state.columns if c != "source_key"]
    order = F.struct("captured_at", "attempts", "status", "document_id", "content_sha256", "config_sha256")
    return batch_state.where("source_key is not null").groupBy("source_key").agg(F.max_by(F.struct(*cols), order).alias("s")).select("source_key", "s.*")


def is_fresh(source: Column, content: Column, cached: Column, captured_at: Column, now: Column, max_age: int | None = None) -> Column:
    """Whether a cached result still holds: young enough, or a URL, or a file with the same content."""
    same = source.rlike("^https?://") | F.coalesce(content == cached, F.lit(False))
    if max_age is None:
        return same
    young = F.unix_timestamp(now) - F.unix_timestamp(captured_at) < max_age
    return F.coalesce(young, F.lit(False)) | same


def resume_plan(items: DataFrame, batch_state: DataFrame, config: str, now: Column | None = None, force: bool = False, max_age: int | None = None) -> DataFrame:
    """``items`` (source_key, source, content_sha256) with ``action``: skip or process, and ``reason``.

    Skipped is what finished under the same configuration and is still fresh, unless a refresh is forced.
    """
    state = latest_state(batch_state).select("source_key", "status", F.col("captured_at").alias("done_at"), plain_hash(F.col("content_sha256")).alias("done"), plain_hash(F.col("config_sha256")).alias("done_config"), "document_dir")
    rows = items.join(state, "source_key", "left")
    fresh = is_fresh(F.col("source"), plain_hash(F.col("content_sha256")), F.col("done"), F.col("done_at"), now if now is not None else F.current_timestamp(), max_age)
    finished = F.coalesce(F.col("status").isin(*FINISHED), F.lit(False))
    same = F.coalesce(F.col("done_config") == config, F.lit(False)) & F.col("done").isNotNull()
    whole = F.col("document_dir").isNotNull()
    reason = (
        F.when(F.lit(force), "forced").when(F.col("status").isNull(), "new").when(~finished, "unfinished").when(~same, "configuration changed").when(~whole, "partial").when(~fresh, "stale").otherwise("cached")
    )
    return rows.select("source_key", "source", reason.alias("reason"), F.when(reason == "cached", "skip").otherwise("process").alias("action"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: totals of a batch by status, and how many were skipped."""
    s = F.col("status")
    counts = [F.count_if(s == k).alias(k) for k in ("accepted", "review", "rejected", "failed")]
    return results.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(~s.isin(*FINISHED, "failed")).alias("unfinished"))


def failures(results: DataFrame) -> DataFrame:
    """Sources that failed, with what is known of why."""
    return results.where("status = 'failed'").select("source_key", "attempts", F.coalesce("error", F.lit("unknown")).alias("error"))


def expand_pages(documents: DataFrame) -> DataFrame:
    """(document_id, page_number) of every page of documents with ``pages_total``."""
    return documents.where("pages_total > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("pages_total"))).alias("page_number"))


def compatible_shards(states: DataFrame, current: DataFrame, model: str, revision: str, schema: str) -> DataFrame:
    """Verified page shards that fit the current source, configuration, model and schema, with a whole payload."""
    joined = states.join(current, "document_id")
    fits = (
        (F.col("state") == "verified") & (F.col("source_pdf_sha256") == F.col("current_sha256")) & (F.col("config_sha256") == F.col("current_config"))
        & (F.col("model_repo") == model) & (F.col("model_revision") == revision) & (F.col("extraction_schema") == schema)
    )
    return joined.where(F.coalesce(fits, F.lit(False))).select(*states.columns)


#: A page that took longer is suspicious.
SLOW_SECONDS = 300


def full_completeness(pages: DataFrame, markdown: DataFrame | None = None, merges: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """One row per document: 22 measures of its pages, visuals, Markdown and reconstruction, and a hard verdict of ten terms.

    ``pages`` has page_number, state, native_text_chars, visual_count, visuals_represented, fallbacks, suspicious and, where known,
    visuals_uncertain, visuals_missing and seconds; ``markdown`` the documents' Markdown; ``merges`` what ``reconstruction_stats`` gives;
    ``expected`` the documents' pages_total, else the greatest page number. Pages of 1 to pages_total without a row count as
    missing. Measures of a table that isn't given are 0.
    """
    state = lambda *names: F.coalesce(F.col("state").isin(*names), F.lit(False))
    given = lambda name, other: F.coalesce(F.col(name), other) if name in pages.columns else other
    of = lambda name: F.coalesce(F.col(name), F.lit(0))
    odd = F.coalesce("suspicious", F.lit(False)) | (given("seconds", F.lit(0.0)) > SLOW_SECONDS)
    out = pages.groupBy("document_id").agg(
        F.max("page_number").alias("__last"), F.count_distinct(F.when(F.col("page_number") >= 1, F.col("page_number"))).alias("__told"), F.count_if(state("missing") | F.col("state").isNull()).alias("__missing"),
        F.count_if(state("verified")).alias("pages_verified"), F.count_if(state("failed")).alias("pages_failed"), F.count_if(odd).alias("pages_suspicious"),
        F.sum(of("visual_count")).alias("visuals_total"), F.sum(of("visuals_represented")).alias("visuals_represented"), F.sum(given("visuals_uncertain", F.lit(0))).alias("visuals_uncertain"),
        F.sum(given("visuals_missing", F.greatest(F.lit(0), of("visual_count") - of("visuals_represented")))).alias("visuals_missing"), F.sum(of("native_text_chars")).alias("native_text_chars_total"),
        F.sum(of("fallbacks")).alias("fallback_count"),
    )
    out = out.join(expected.select("document_id", F.col("pages_total").alias("__expected")), "document_id", "left") if expected is not None else out.withColumn("__expected", F.col("__last"))
    total = F.greatest(F.coalesce("__expected", F.lit(0)), F.coalesce("__last", F.lit(0)))
    absent = F.greatest(F.lit(0), total - F.col("__told"))
    out = out.withColumn("pages_total", total).withColumn("pages_visited", F.col("__told") + absent).withColumn("page_sequence_gaps", absent + F.col("__missing"))
    shown = ["final_markdown_chars", "markdown_image_count", "html_img_count", "base64_image_count", "unclosed_fence_count"]
    if markdown is not None:
        md, low = F.coalesce("markdown", F.lit("")), F.lower(F.coalesce("markdown", F.lit("")))
        counted = markdown.select(
            "document_id", F.length(md).alias(shown[0]), F.regexp_count(md, F.lit(IMAGE_MARKDOWN)).alias(shown[1]), F.regexp_count(low, F.lit("<img")).alias(shown[2]), F.regexp_count(low, F.lit("data:image/")).alias(shown[3]), unclosed_fence(md, strict=False).alias(shown[4])
        )
        out = out.join(counted, "document_id", "left").na.fill(0, shown)
    else:
        out = out.withColumns({n: F.lit(0) for n in shown})
    made = ["furniture_removed_count", "cross_page_paragraph_merges", "cross_page_code_merges", "unsafe_merge_candidates_skipped"]
    told = ["furniture_removed", "paragraph_merges", "code_merges", "unsafe_skipped"]
    out = out.join(merges.select("document_id", *[F.col(x).alias(n) for x, n in zip(told, made)]), "document_id", "left").na.fill(0, made) if merges is not None else out.withColumns({n: F.lit(0) for n in made})
    out = out.withColumn("native_text_coverage_ratio", F.col("final_markdown_chars") / F.greatest(F.lit(1), "native_text_chars_total"))
    whole = (F.col("pages_visited") == F.col("pages_total")) & (F.col("pages_verified") == F.col("pages_total"))
    none = ["pages_failed", "page_sequence_gaps", "visuals_missing", "markdown_image_count", "html_img_count", "base64_image_count", "unclosed_fence_count", "fallback_count"]
    hard = reduce(lambda x, n: x & (F.col(n) == 0), none, whole)
    return out.withColumn("hard_pass", hard).drop("__last", "__told", "__missing", "__expected")


def page_seconds(started: Column, completed: Column) -> Column:
    """Seconds of a page's work; 0 where a time is missing or they run backwards."""
    return F.coalesce(F.greatest(F.lit(0.0), completed.cast("double") - started.cast("double")), F.lit(0.0))


def running_performance(pages: DataFrame) -> DataFrame:
    """Per page of a run (document_id, page_number, pages_total, seconds, calls, latency, rss): totals so far, pages a minute, time left, peak memory."""
    w = W.partitionBy("document_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, 0)
    elapsed = F.greatest(F.lit(0.001), F.sum("seconds").over(w))
    rate = F.col("page_number") / elapsed * 60.0
    left = F.greatest(F.lit(0), F.col("pages_total") - F.col("page_number"))
    return pages.select(
        "document_id", "page_number", elapsed.alias("elapsed_s"), rate.alias("pages_per_minute"), (left / F.greatest(F.lit(0.001), rate / 60.0)).alias("estimated_remaining_s"),
        F.sum("calls").over(w).alias("calls_total"), F.sum("latency").over(w).alias("latency_total_s"), F.max("rss").over(w).alias("peak_rss_bytes"),
    )


def inventory(files: DataFrame) -> DataFrame:
    """Files (path, length, content) classified, hashed and counted by kind: (path, kind, sha256, length, same) with how many share the content."""
    kind = F.when(F.lower("path").rlike(r"\.pdf$"), "pdf").when(F.lower("path").rlike(r"\.html?$"), "html").when(F.lower("path").rlike(r"\.(png|jpe?g|webp|tiff?|avif|svg)$"), "image").otherwise("other")
    rows = files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "length")
    return rows.join(rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("same")), "sha256")
