"""Document-level reconstruction: running headers and footers go, blocks that a page break cut are merged."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import lookup_join, materialize
from quirewright.functions.text import collapse, strip
from quirewright.operators.quality import effective_language, effective_text

EDGE, LONGEST, DRIFT, LOW_EDGE = 90.0, 160, 36.0, 700.0
# What generators write into every page, visual types that are code, and patterns of the signature in order.
GENERATORS = r"(?i)\b(?:powered by|created with|generated by) tcpdf\b"
CODE_TYPES = ("code", "terminal", "http", "diff", "configuration", "log", "stack_trace")
SIGNATURE = (
    (r"\bpage\s+\d{1,4}\b", "page#"),
    (r"\b\d{1,4}\s+chapter\s+\d{1,3}\b", "chapter#"),
    (r"\bchapter\s+\d{1,3}\s+\d{1,4}\b", "chapter#"),
    (r"\bchapter\s+\d{1,3}\b", "chapter#"),
    (r"\b\d{1,4}\b", "#"),
)
CODEISH = r"(--\w+|https?://|/[A-Za-z0-9_.\-/]+|[A-Za-z_][A-Za-z0-9_]*\(|[0-9a-f]{16,})"


def furniture_signature(text: Column) -> Column:
    """A text without what differs from page to page: case, spacing, punctuation between words, page and chapter numbers."""
    c = F.translate(collapse(text), "’–—", "'--")
    c = reduce(lambda x, rule: F.regexp_replace(x, "(?U)" + rule[0], rule[1]), SIGNATURE, c)
    c = strip(F.regexp_replace(c, r"(?U)[\s.\-_:|]+", " "))
    return F.when(c.rlike(GENERATORS), "generator:tcpdf").when(c.isin("page#", "#"), "page-number").otherwise(c)


def is_page_number(text: Column) -> Column:
    """A number of up to four digits, perhaps after ``page``."""
    return strip(text).rlike(r"(?iU)^(page\s*)?\d{1,4}$")


def is_generator(text: Column) -> Column:
    """A line that a PDF generator leaves."""
    return F.regexp_replace(text, r"\s+", " ").rlike(GENERATORS)


def located(blocks: DataFrame) -> DataFrame:
    """Blocks with ``eff_text`` and the page, top and bottom that their first evidence tells."""
    first = F.get("evidence", 0)
    return blocks.withColumns({"eff_text": effective_text(), "ev_page": first["page"], "y0": F.get(first["bbox"], 1), "y1": F.get(first["bbox"], 3)})


def page_bands(blocks: DataFrame) -> DataFrame:
    """``located`` blocks with ``band``: top, bottom or body, by the page's lowest block. One join on (document, page), no window over rows."""
    loc = located(blocks)
    bottoms = loc.where("ev_page is not null and y1 is not null").groupBy("document_id", "ev_page").agg(F.max("y1").alias("bottom"))
    both = loc.join(bottoms, ["document_id", "ev_page"], "left")
    low = F.coalesce("bottom", F.lit(0.0))
    band = F.when(F.col("y0").isNull() | F.col("ev_page").isNull(), "body").when(F.col("y0") <= EDGE, "top").when((low > 500) & (F.col("y1") >= low - EDGE), "bottom").when(F.col("y1") > LOW_EDGE, "bottom")
    return both.withColumn("band", band.otherwise("body")).drop("bottom")


def furniture(blocks: DataFrame) -> DataFrame:
    """(document_id, signature, reason, evidence_count, pages, confidence) of repeated furniture of each document.

    A block counts as evidence if it is short, stands in an edge band (page numbers and generator lines anywhere) and is a
    paragraph, a heading or a visual with a generator line. The number of distinct pages decides; the first block in order
    tells the kind.
    """
    eff = F.col("eff_text")
    banded = page_bands(blocks).withColumn("signature", furniture_signature(F.col("eff_text")))
    pages = blocks.select("document_id", F.get("evidence", 0)["page"].alias("p")).groupBy("document_id").agg(F.count_distinct("p").alias("page_count"))
    short = (strip(eff) != "") & (F.length(strip(eff)) <= LONGEST) & F.col("ev_page").isNotNull() & F.col("y0").isNotNull()
    counts = F.col("type").isin("paragraph", "heading") | ((F.col("type") == "visual") & is_generator(eff))
    placed = (F.col("band") != "body") | is_page_number(eff) | is_generator(eff)
    hits = banded.where(counts & short & placed & (F.col("signature") != ""))
    by = hits.groupBy("document_id", "signature").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.array_sort(F.collect_set("ev_page")).alias("pages"), F.min("y0").alias("lo"), F.max("y0").alias("hi"), F.count("y0").alias("n"),
        F.min(F.struct("block_order", "block_id", is_generator(eff).alias("generator"), is_page_number(eff).alias("number"))).alias("first"),
    ).join(pages, "document_id")
    n, total = F.size("pages"), F.col("page_count")
    steady = (F.col("n") >= 2) & (F.col("hi") - F.col("lo") <= DRIFT)
    strong = (
        F.when(F.col("first.generator"), (n >= 2) | (total <= 3))
        .when(F.col("first.number") | (F.col("signature") == "page-number"), n >= 2)
        .otherwise((n >= F.greatest(F.lit(3), F.floor(total * 0.25))) & steady)
    )
    sure = 0.65 + 0.3 * F.least(F.lit(1.0), n / F.greatest(F.lit(1), total)) + F.when(F.col("first.generator") | F.col("first.number"), 0.15).otherwise(0.0) + F.when(steady, 0.1).otherwise(0.0)
    reason = F.when(F.col("first.generator"), "known PDF generator footer/header").when(F.col("first.number") | (F.col("signature") == "page-number"), "page-number-only furniture").otherwise("repeated header/footer/running-title candidate")
    return by.where((total >= 3) & strong).select("document_id", "signature", reason.alias("reason"), "evidence_count", "pages", F.least(F.lit(0.99), F.round(sure, 3)).alias("confidence"))


def removed_furniture(blocks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Blocks that are furniture: every eligible block with a repeated signature, wherever it stands."""
    found = materialize(furniture(blocks), "furniture") if found is None else found
    loc = located(blocks).withColumn("signature", furniture_signature(F.col("eff_text")))
    eligible = F.col("type").isin("paragraph", "heading") | ((F.col("type") == "visual") & is_generator(F.col("eff_text")))
    joined = lookup_join(loc.where(eligible), found, ["document_id", "signature"], spread=["block_id"], materialized=True)
    return joined.select("document_id", "block_id", F.col("ev_page").alias("page"), F.col("eff_text").alias("text"), "reason", "signature", "evidence_count", "confidence")


# ---- merging over page breaks -----------------------------------------------------------------------------------

_ENDS = re.compile(r"[.!?:;。！？]$")
_SENTENCE = re.compile(r"[.!?。！？]$")
_GOES_ON = re.compile(r"^[a-z,，)]")
_CODEISH = re.compile(CODEISH)
_NUMBER = re.compile(r"^\s*(\d{1,5})\b")


def _number(lines: list[str]) -> int | None:
    return next((int(m[1]) for m in map(_NUMBER.match, lines) if m), None)


def numbers_continue(a: str, b: str) -> bool:
    """Whether line numbers at the end of one text go on at the start of the next."""
    last, first = _number(a.splitlines()[::-1]), _number(b.splitlines())
    return last is not None and first is not None and first - last in (1, 2)


def merge_decision(prev: dict, block: dict) -> tuple[str, str, list[str]]:
    """(prose | code | unsafe | none, merged text, transformations) for neighbours on adjacent pages."""
    a, b = prev["eff_text"].rstrip(), block["eff_text"].lstrip()
    if not a or not b:
        return "none", "", []
    if prev["type"] == block["type"] == "paragraph" and not _CODEISH.search(a) and not _CODEISH.search(b) and not _ENDS.search(a) and _GOES_ON.match(b):
        if a.endswith("-") and b[0].islower() and not _CODEISH.search(a[-40:] + b[:40]):
            return "prose", a[:-1] + b, ["merged_cross_page_paragraph", "dehyphenated_cross_page_prose"]
        return "prose", f"{a} {b}", ["merged_cross_page_paragraph"]
    if prev["codeish"] and block["codeish"] and prev["eff_language"] == block["eff_language"]:
        open_end = re.search(r"[{(\[:]\s*$", a) or any(a.count(o) > a.count(c) for o, c in ("()", "[]", "{}"))
        if open_end or numbers_continue(a, b) or b[0] in ".)]}":
            return "code", prev["eff_text"].rstrip("\n") + "\n" + block["eff_text"].lstrip("\n"), ["merged_cross_page_code"]
    if not _SENTENCE.search(a) and (_GOES_ON.match(b) or numbers_continue(a, b)):
        return "unsafe", "", []
    return "none", "", []


MERGED = "document_id string, block_order int, block_id string, type string, page int, text string, language string, merged_blocks array<string>, transformations array<string>, unsafe_next array<string>"


_FIELDS = [f.split(" ")[0] for f in MERGED.split(", ")]


def _fold(batches):
    """Fold over rows sorted by document and order. Only the block still open is held, so a document may be of any length."""
    import pandas as pd

    doc, last, order = None, None, 0

    def closed(block: dict) -> tuple:
        return (doc, order, block["block_id"], block["type"], block["page"], block["eff_text"], block["eff_language"], block["merged"], block["steps"], block["unsafe"])

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_FIELDS)
        out["page"] = pd.array(out["page"].tolist(), "Int32")
        return out.astype({"block_order": "int32"})

    for pdf in batches:
        out: list[tuple] = []
        for d, block_id, kind, page, text, language, codeish in zip(*(pdf[c] for c in ("document_id", "block_id", "type", "ev_page", "eff_text", "eff_language", "codeish"))):
            block = {"block_id": block_id, "type": kind, "page": None if page is None or page != page else int(page), "eff_text": text, "eff_language": language, "codeish": bool(codeish), "merged": [], "steps": [], "unsafe": []}
            if last is not None and d != doc:
                out.append(closed(last))
                last = None
            if last is None:
                doc, last, order = d, block, 0
                continue
            if last["page"] is not None and block["page"] == last["page"] + 1:
                made, merged, steps = merge_decision(last, block)
                if made in ("prose", "code"):
                    last["eff_text"] = merged
                    last["merged"].append(block_id)
                    last["steps"] += steps
                    continue
                if made == "unsafe":
                    last["unsafe"].append(block_id)
            out.append(closed(last))
            last, order = block, order + 1
        yield frame(out)
    if last is not None:
        yield frame([closed(last)])


def merge_pages(blocks: DataFrame) -> DataFrame:
    """Blocks of each document in order, those cut by a page break merged: a fold, because each decision reads the text merged so far.

    Documents are hashed to partitions and sorted there; the fold streams over the sorted rows, seven narrow columns of them.
    Repeated rows count once; rows without a document are left out.
    """
    codeish = (F.col("type") == "native_code") | ((F.col("type") == "visual") & F.coalesce("visual_type", F.lit("")).isin(*CODE_TYPES))
    narrow = located(blocks).where("document_id is not null").select("document_id", "block_order", "block_id", "type", "ev_page", "eff_text", effective_language().alias("eff_language"), codeish.alias("codeish")).distinct()
    return narrow.repartition("document_id").sortWithinPartitions("document_id", "block_order", "block_id").mapInPandas(_fold, MERGED)


def reconstruct(blocks: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Furniture removed (``removed``, if it is known already), then pages merged."""
    gone = (removed_furniture(blocks) if removed is None else removed).select("document_id", "block_id").distinct()
    return merge_pages(lookup_join(blocks, gone, ["document_id", "block_id"], "left_anti"))


def reconstruction_stats(blocks: DataFrame, merged: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per document: furniture removed, merges of either kind, unsafe candidates left."""
    m = merged.groupBy("document_id").agg(
        F.sum(F.size(F.filter("transformations", lambda t: t == "merged_cross_page_paragraph"))).alias("paragraph_merges"),
        F.sum(F.size(F.filter("transformations", lambda t: t == "merged_cross_page_code"))).alias("code_merges"), F.sum(F.size("unsafe_next")).alias("unsafe_skipped"),
    )
    r = removed.groupBy("document_id").agg(F.count_distinct("block_id").alias("furniture_removed"))
    return m.join(r, "document_id", "left").na.fill(0, ["furniture_removed"])
