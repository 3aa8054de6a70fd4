"""Markdown of blocks and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.functions.text import code_fence, normal_text, strip, strip_image_references

# Language tag of a fence by visual type.
FENCE_LANGUAGE = {"terminal": "bash", "http": "http", "diff": "diff", "log": "log", "stack_trace": "log"}
#: Name in the comment markers of strict mode.
MARKER = "quirewright"


def _fence_language(visual_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FENCE_LANGUAGE.items() for x in kv])
    return F.coalesce(F.element_at(table, visual_type), F.lit(""))


def table_markdown(rows: Column) -> Column:
    """A pipe table; rows are padded or cut to the width of the first."""
    head = F.element_at(rows, 1)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(head) - F.size(r), F.lit(0)))), 1, F.size(head))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: line(fit(r)))
    rule = line(F.transform(head, lambda _: F.lit("---")))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def visual_markdown(mode: str = "document") -> Column:
    """A visual by its state: its transcription, a notice with it, or a notice alone; nothing if decorative."""
    kind = F.coalesce("visual_type", F.lit("unknown"))
    e = F.col("enrichment")
    text = normal_text(F.coalesce(F.nullif(e["selected_text"], F.lit("")), e["raw_text"], F.lit("")))
    blank = strip(text) == ""
    lang = F.coalesce(F.nullif(e["language"], F.lit("")), _fence_language(e["visual_type"]))
    shown = code_fence(text, lang)

    def notice(reason: Column) -> Column:
        if mode == "strict":
            return F.concat(F.lit(f"<!-- {MARKER}: [UNRESOLVED] visual="), kind, F.lit(" block="), F.col("block_id"), F.lit(" -->\n"))
        return F.concat(F.lit("> The source contains an unresolved "), kind, F.lit(" visual at this position ("), reason, F.lit(").\n"))

    empty = notice(F.lit("OCR returned empty output"))
    if mode == "strict":
        doubtful = F.concat(F.lit(f"<!-- {MARKER}: [REVIEW REQUIRED] visual="), kind, F.lit(" block="), F.col("block_id"), F.lit(" -->\n"))
    else:
        doubtful = F.concat(
            F.lit("> The source contains a "), kind, F.lit(" visual at this position whose transcription is uncertain. A partial transcription follows:\n"), shown
        )
    why = F.coalesce(F.nullif(F.array_join(e["transformations"], "; "), F.lit("")), F.lit("OCR failed"))
    state = F.coalesce("visual_state", F.lit(""))
    return (
        F.when(state == "ignored_decorative", "")
        .when(state.isin("resolved_ocr", "resolved_structured") & e.isNotNull(), F.when(blank, empty).otherwise(shown))
        .when((state == "review_required") & e.isNotNull(), F.when(blank, empty).otherwise(doubtful))
        .when(state == "failed", notice(why))
        .otherwise(notice(F.lit("visual not enriched")))
    )


def block_markdown(columns: list[str], mode: str = "document") -> Column:
    """Markdown of one block by its type. ``columns`` tells which of the optional columns there are."""
    text = normal_text(F.coalesce("text", F.lit("")))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.when(F.coalesce("heading_level", F.lit(0)) == 0, 2).otherwise(F.col("heading_level"))))
    items = F.array_join(F.transform(F.coalesce("list_items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    quote = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    kind = F.col("type")
    out = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), strip(F.coalesce("text", F.lit("")))))
        .when(kind == "list", normal_text(items))
        .when(kind == "quote", quote)
        .when(kind == "horizontal_rule", "---")
        .when(kind == "native_code", code_fence(text, F.coalesce("language", F.lit(""))))
        .when(kind == "visual", visual_markdown(mode))
    )
    if "table_rows" in columns:
        out = out.when(kind == "table", table_markdown(F.col("table_rows")))
    return out.otherwise(text)


def render_documents(blocks: DataFrame, mode: str = "document", strip_images: bool = True) -> DataFrame:
    """(document_id, markdown): blocks in order; every one but the document's last is followed by an empty part.

    Blocks of a document are gathered at this sink only, and as rendered strings. Repeated rows count once.
    """
    made = blocks.select("document_id", "block_order", "block_id", block_markdown(blocks.columns, mode).alias("md")).distinct()
    parts = made.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "md"))).alias("parts"))
    last = F.element_at("parts", -1)
    kept = F.filter("parts", lambda p: p["md"] != "")
    pieces = F.flatten(F.transform(kept, lambda p: F.when((p["block_order"] == last["block_order"]) & (p["block_id"] == last["block_id"]), F.array(p["md"])).otherwise(F.array(p["md"], F.lit("")))))
    md = F.concat(strip(F.array_join(pieces, "\n\n")), F.lit("\n"))
    return parts.select("document_id", (strip_image_references(md) if strip_images else md).alias("markdown"))


def provenance(blocks: DataFrame) -> DataFrame:
    """One row per block: where it comes from, what was done to it, its raw and final text."""
    e = F.col("enrichment")
    none = F.array().cast("array<string>")
    return blocks.select(
        "document_id", "block_id", F.coalesce("source_kind", F.lit("unknown")).alias("source_kind"), F.coalesce("provenance_source_ref", F.lit("")).alias("source_ref"), F.size(F.coalesce("evidence", F.array().cast(blocks.schema["evidence"].dataType))).alias("evidence_count"),
        F.coalesce(e["transformations"], none).alias("transformations"), F.coalesce(e["raw_text"], F.col("text")).alias("raw_text"), block_markdown(blocks.columns).alias("final_text"),
    )
