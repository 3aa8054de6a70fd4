"""Whole jobs: from blocks to rendered, judged and published documents; evaluation of a golden set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import materialize
from quirewright.config import Config
from quirewright.functions.text import count_image_references, document_id, folder_name, strip
from quirewright.operators import evaluate, html, pages, quality, reconstruct, render
from quirewright.sources import sinks


@dataclass
class Finalized:
    """The tables of a finished job, all keyed by document_id."""

    blocks: DataFrame
    markdown: DataFrame
    diagnostics: DataFrame
    provenance: DataFrame
    completeness: DataFrame


def diagnostics(blocks: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row per document: counts by type, unresolved and doubtful blocks, buckets of confidence, coverage, score. Lists are bounded by the document's own blocks."""
    report = quality.quality_report(blocks) if report is None else report
    listed = blocks.groupBy("document_id").agg(
        F.array_sort(F.collect_set(F.when(quality.is_unresolved(), F.col("block_id")))).alias("unresolved_blocks"), F.array_sort(F.collect_set(F.when(quality.is_low_confidence(), F.col("block_id")))).alias("doubtful_blocks")
    )
    covered = quality.coverage_summary(blocks).select("document_id", F.struct(*quality.COVERAGE, "missing", "all_covered").alias("visual_coverage"))
    return report.join(quality.counts_by_type(blocks), "document_id", "left").join(listed, "document_id", "left").join(covered, "document_id", "left")


def finalize(blocks: DataFrame, config: Config, errors: DataFrame | None = None, out: str | None = None) -> Finalized:
    """Render, judge and, with ``out``, publish every document of ``blocks``.

    ``errors`` has document_id and n of hard errors. Blocks are materialized once; all tables derive from them. The published tables are
    partitioned by status and replaced by partition; ledgers are JSON; one Markdown file per document.
    """
    b = materialize(blocks.distinct(), "blocks")
    raw = render.render_documents(b, config.quality.mode, strip_images=False).withColumn("images", count_image_references(F.col("markdown")))
    raw = materialize(raw, "rendered")
    md = materialize(render.render_documents(b, config.quality.mode), "markdown")
    whole = quality.completeness(md, b, config.quality.mode)
    report = quality.quality_report(b, F.lit(0)).drop("markdown_image_count").join(raw.select("document_id", F.col("images").cast("long").alias("markdown_image_count")), "document_id", "left")
    odd = quality.suspicious(b, md)
    joined = diagnostics(b, report).join(raw.select("document_id", (strip(F.col("markdown")) == "").alias("__empty")), "document_id", "left")
    joined = joined.join(whole.select("document_id", F.col("failed").alias("__failed")), "document_id", "left").join(odd, "document_id", "left")
    joined = joined.join(errors.select("document_id", F.col("n").alias("__errors")), "document_id", "left") if errors is not None else joined.withColumn("__errors", F.lit(0))
    unresolved = F.col("unresolved_visual_count") if config.quality.accepted_needs_all_resolved else F.lit(0)
    st = quality.status(
        empty=F.coalesce("__empty", F.lit(True)), images=F.coalesce("markdown_image_count", F.lit(0)), unresolved=unresolved, errors=F.coalesce("__errors", F.lit(0)),
        incomplete=F.coalesce("__failed", F.lit(0)) > 0, odd=F.coalesce("suspicious", F.lit(False)), policy=config.quality.unresolved_policy,
    )
    diag = materialize(joined.withColumn("status", st).drop("__empty", "__failed", "__errors"), "diagnostics")
    done = Finalized(b, md, diag, render.provenance(b), whole)
    if out:
        sinks.write_table(done.blocks.join(diag.select("document_id", "status"), "document_id"), f"{out}/blocks", ["status"])
        sinks.write_table(diag, f"{out}/diagnostics", ["status"])
        sinks.write_ledger(done.provenance, f"{out}/provenance")
        sinks.write_ledger(done.completeness, f"{out}/completeness")
        sinks.write_markdown(done.markdown, f"{out}/markdown")
    return done


def convert_html(source_pages: DataFrame, config: Config) -> DataFrame:
    """Blocks of HTML pages (source_ref, html), with document ids from reference, content and configuration."""
    ident = document_id(F.col("source_ref"), F.sha2(F.coalesce("html", F.lit("")), 256), F.lit(config.sha256()))
    ids = source_pages.select("source_ref", ident.alias("document_id")).distinct()
    return _as_blocks(html.html_blocks(source_pages).join(ids, "source_ref"), "html")


def convert_pages(page_blocks: DataFrame) -> DataFrame:
    """Blocks of PDF page blocks: code recognized, hidden text layers that repeat native text dropped, reading order, page breaks merged."""
    made = pages.page_blocks_to_blocks(pages.without_duplicate_ocr(page_blocks))
    boxes = page_blocks.select("pb_id", "bbox").dropDuplicates(["pb_id"])
    return _as_blocks(made.join(boxes, "pb_id", "left"), "pdf")


_ENRICHMENT = "struct<visual_type:string,raw_text:string,selected_text:string,language:string,segments:array<struct<role:string,text:string,command:string>>,confidence:double,review_required:boolean,transformations:array<string>,backend:string,backend_version:string>"
_EVIDENCE = "array<struct<kind:string,page:int,bbox:array<double>,url:string,selector:string,asset_path:string,content_sha256:string>>"


def _as_blocks(df: DataFrame, kind: str) -> DataFrame:
    """The central relation, with NULL for what a source doesn't have."""

    def col(name: str, typ: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(typ).alias(name)

    page, box, sel = (col(n, t) for n, t in (("page", "int"), ("bbox", "array<double>"), ("selector", "string")))
    evidence = F.array(
        F.struct(
            F.lit("pdf_region" if kind == "pdf" else "dom_element").alias("kind"), page, box, F.lit(None).cast("string").alias("url"), sel, F.lit(None).cast("string").alias("asset_path"), F.lit(None).cast("string").alias("content_sha256")
        )
    )
    return df.select(
        "document_id", col("block_order", "int"), "block_id", "type", col("text", "string"), col("language", "string"), col("heading_level", "int"), col("list_items", "array<string>"), col("table_rows", "array<array<string>>"), col("page", "int"),
        col("visual_type", "string"), col("visual_state", "string"), F.lit(None).cast(_ENRICHMENT).alias("enrichment"), evidence.cast(_EVIDENCE).alias("evidence"),
        (F.col("source_ref") if "source_ref" in df.columns else F.lit(None).cast("string")).alias("provenance_source_ref"), F.lit(kind).alias("source_kind"), col("coverage_state", "string"), col("coverage_reason", "string"),
    )


def with_reconstruction(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged blocks, removed furniture) of PDF documents."""
    gone = materialize(reconstruct.removed_furniture(blocks), "removed")
    return reconstruct.reconstruct(blocks, gone), gone


def inspect(diag: DataFrame, manifests: DataFrame, markdown: DataFrame) -> DataFrame:
    """One row per document: what a reader asks of it first."""
    newest = manifests.groupBy("document_id").agg(F.max_by(F.struct("source", "source_type", "canonical_source", "content_sha256"), F.struct("captured_at", "source")).alias("m"))
    rows = newest.join(diag.select("document_id", "status", "overall_quality_score", "blocks", "unresolved_visual_count"), "document_id")
    images = F.regexp_count("markdown", F.lit(r"!\[")) + F.regexp_count("markdown", F.lit("<img"))
    rows = rows.join(markdown.select("document_id", images.alias("markdown_images")), "document_id", "left")
    folder = folder_name(F.col("m.canonical_source"), F.col("m.source_type"), F.col("m.content_sha256"))
    return rows.select("document_id", "m.source", "m.source_type", "status", "overall_quality_score", "blocks", "unresolved_visual_count", F.coalesce("markdown_images", F.lit(0)).alias("markdown_images"), folder.alias("folder"))


def prefixed_evidence(evidence: Column, prefix: Column) -> Column:
    """Evidence with its asset paths under a page's folder; empty paths stay empty."""
    path = lambda e: F.when(F.coalesce(e["asset_path"], F.lit("")) == "", e["asset_path"]).otherwise(F.concat(prefix, F.lit("/"), e["asset_path"]))
    return F.transform(evidence, lambda e: e.withField("asset_path", path(e)))


def compile_shards(shards: DataFrame, valid: DataFrame) -> DataFrame:
    """Blocks of the page shards that are verified and compatible, evidence under the page's folder."""
    kept = shards.join(valid.select("document_id", F.col("page_number").alias("page")).distinct(), ["document_id", "page"], "left_semi")
    return kept.withColumn("evidence", prefixed_evidence(F.col("evidence"), F.format_string("pages/%04d", "page")))


def evaluate_golden(golden: DataFrame, results: DataFrame, thresholds: list[tuple[float, float]], out: str | None = None) -> dict[str, DataFrame]:
    """Metrics, aggregates, calibration and errors of a golden set against results (sample_id, actual, confidence); with ``out`` written as ledgers and a report."""
    pairs, errors = evaluate.pair_up(golden, results)
    m = materialize(evaluate.sample_metrics(pairs), "metrics")
    made = {"metrics": m, "aggregates": evaluate.aggregate(m), "calibration": evaluate.calibrate(m, thresholds), "errors": errors}
    if out:
        for name, df in made.items():
            sinks.write_ledger(df, f"{out}/{name}")
        evaluate.report_markdown(made["aggregates"]).select(F.col("markdown").alias("value")).write.mode("overwrite").text(f"{out}/report")
    return made
