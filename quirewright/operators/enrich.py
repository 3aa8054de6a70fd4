"""Enrichment of visuals: the recognizer protocol, context, repair, choice among views, and the states that follow.

Models are not part of this library. A recognizer is any object with a name, a version and ``recognize``, which takes an
iterator of batches of image bytes and gives results; the table-backed one here is a join on the content's hash, so it is
deterministic and distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.cluster import once
from quirewright.functions.code import ascii_punctuation, classify_context, classify_text, detect_language, looks_space_merged, panels, post_process, recover_indentation, split_merged, structural_score
from quirewright.functions.text import strip
from quirewright.operators.quality import RESOLVED

RESULT = "text string, confidence double, regions array<struct<bbox:array<double>,text:string,confidence:double>>"
CONTEXT_CHARS, HIGH_CONFIDENCE = 400, 0.99
# Order of preference among recognizers found, and other names they go by.
PROBE_ORDER = ("table", "external")
ALIASES = {"mock": "table", "auto": ""}


class Recognizer(Protocol):
    """What turns image bytes into text."""

    name: str
    version: str

    def recognize(self, images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Text, confidence and regions of each image of each batch; a model is loaded once per iterator."""
        ...


_registry: dict[str, Callable[[], Recognizer]] = {}


def register(name: str, make: Callable[[], Recognizer]) -> None:
    """Make a recognizer known by name."""
    _registry[name] = make


def recognizer(name: str) -> Recognizer:
    """The recognizer of a name or alias; ``auto`` probes for one and never falls back silently on a named one."""
    name = ALIASES.get(name, name)
    for candidate in [name] if name else [p for p in PROBE_ORDER if p in _registry]:
        if candidate in _registry:
            return _registry[candidate]()
    raise LookupError(f"no recognizer {name!r}; known: {', '.join(sorted(_registry)) or 'none'}")


def recognize(images: DataFrame, engine: Recognizer, column: str = "content") -> DataFrame:
    """``images`` with text, confidence and regions from an engine, one model per Python worker."""
    run = F.pandas_udf(_typed(engine), RESULT)
    return images.withColumn("__r", run(column)).select(*images.columns, "__r.text", "__r.confidence", "__r.regions")


def _typed(engine: Recognizer):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from engine.recognize(batches)

    return run


def recognize_by_table(images: DataFrame, results: DataFrame) -> DataFrame:
    """``images`` (with content_sha256) joined to known results (content_sha256, text, confidence); unknown images give empty text and 0."""
    known = results.groupBy("content_sha256").agg(F.max(F.struct("confidence", "text")).alias("r"))
    joined = images.join(known, "content_sha256", "left")
    return joined.withColumn("text", F.coalesce("r.text", F.lit(""))).withColumn("confidence", F.coalesce("r.confidence", F.lit(0.0))).drop("r")


def region_confidence(regions: Column) -> Column:
    """Mean confidence of the regions; 0 without any."""
    total = F.aggregate(regions, F.lit(0.0), lambda a, r: a + r["confidence"])
    return F.when(F.size(regions) > 0, total / F.size(regions)).otherwise(0.0)


def joined_text(regions: Column, raw: Column) -> Column:
    """Texts of the regions by line, or the raw text where there are none."""
    return F.when(F.size(regions) > 0, F.array_join(F.transform(regions, lambda r: r["text"]), "\n")).otherwise(raw)


def polygon_box(points: Column) -> Column:
    """Box around a polygon of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def with_context(blocks: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """Visual blocks with ``context``: the text around each, back to nearest first and forward, to a visual or ``chars`` characters.

    Runs of text between visuals are numbered by a running count of visuals, and a running length within a run decides what is still read;
    so no document is gathered whole.
    """
    rows = blocks.select("document_id", "block_order", "block_id", "type", F.coalesce("text", F.lit("")).alias("t")).distinct()
    by_order = W.partitionBy("document_id").orderBy("block_order", "block_id")
    visual = F.col("type") == "visual"
    rows = rows.withColumn("run", F.count_if(visual).over(by_order.rowsBetween(W.unboundedPreceding, 0)))
    text = rows.where(~visual & (F.col("t") != ""))
    up = W.partitionBy("document_id", "run").orderBy("block_order", "block_id")
    down = W.partitionBy("document_id", "run").orderBy(F.desc("block_order"), F.desc("block_id"))
    size = F.length("t")
    seen = lambda w: F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = text.withColumn("ahead", seen(up)).withColumn("behind", seen(down))
    # a run belongs to the visual before it (as what follows) and to the one after it (as what precedes)
    follows = text.where(F.col("ahead") < chars).groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("ahead", "block_order", "t"))).alias("f"))
    precedes = text.where(F.col("behind") < chars).groupBy("document_id", (F.col("run") + 1).alias("run")).agg(F.array_sort(F.collect_list(F.struct("behind", F.negative("block_order").alias("o"), "t"))).alias("p"))
    lines = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["t"]), "\n"), F.lit(""))
    out = rows.where(visual).join(follows, ["document_id", "run"], "left").join(precedes, ["document_id", "run"], "left")
    return out.select("document_id", "block_id", lines(F.col("p")).alias("preceding"), lines(F.col("f")).alias("following"))


def repaired(text: Column, visual_type: Column) -> Column:
    """Selected text from recognized text: post-processed, run-together tokens split, ASCII punctuation, indentation."""
    return recover_indentation(ascii_punctuation(split_merged(post_process(text))["text"]))


def repairs(texts: DataFrame, raw: str, visual_type: str) -> DataFrame:
    """``texts`` with ``selected_text``, as ``repaired`` makes it of the column ``raw``, and ``steps``: what was done to it, in order.

    Every stage is a column that is computed once. As one expression the stages are copied into each of their uses, and above an
    aggregate every copy becomes a column of the rows that wait for Python: 2,220 of them, which filled the disk.
    """
    rows = once(texts, "__clean", post_process(F.col(raw)))
    rows = once(rows, "__split", split_merged(F.col("__clean")))
    rows = once(rows, "__ascii", ascii_punctuation(F.col("__split.text")))
    rows = once(rows, "selected_text", recover_indentation(F.col("__ascii")))
    clean, split, ascii_ = F.col("__clean"), F.col("__split"), F.col("__ascii")
    wide = F.length(split["text"]) - F.length(F.translate(split["text"], "，。：；！？（）［］｛｝＂＇＜＞＝＋－＊／＼＆｜＃％＠＄＾～｀", ""))
    none = F.array().cast("array<string>")
    done = F.concat(
        F.when(clean != F.col(raw), F.array(F.lit("post_processed"))).otherwise(none), split["done"],
        F.when(ascii_ != split["text"], F.array(F.concat(F.lit("fullwidth_punct_normalized:"), wide.cast("string"), F.lit("chars")))).otherwise(none),
        F.when(F.col("selected_text") != ascii_, F.array(F.lit("indent_recovered"))).otherwise(none),
        F.when(F.col(visual_type).isin("terminal", "http", "diff") & (clean != ""), F.array(F.lit("panel_split"))).otherwise(none),
    )
    return rows.select(*texts.columns, "selected_text", done.alias("steps"))


def final_confidence(model: Column, boost: Column, repairs: Column) -> Column:
    """Model confidence plus what structure and repairs add (a hundredth each, five at most), between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), model + boost + F.least(F.lit(0.05), repairs * 0.01)))


def best_candidates(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Of the candidates (key, view, text, confidence, visual_type) the best of each key: structure, confidence, length up to 1000, first view."""
    score = structural_score(F.coalesce("text", F.lit("")), F.col("visual_type"))
    rank = F.struct(score.alias("score"), F.col("confidence"), F.least(F.length("text"), F.lit(1000)).alias("length"), (-F.col("view")).alias("first"))
    best = candidates.groupBy(*key).agg(F.max_by(F.struct("view", "text", "confidence", score.alias("score")), rank).alias("b"))
    return best.select(*key, "b.view", "b.text", "b.confidence", "b.score")


def enrich(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Visual blocks after recognition: (document_id, block_id, visual_type, visual_state, coverage_state, coverage_reason, language, selected_text, confidence, segments).

    ``results`` has document_id, block_id, text, confidence of what was recognized; a visual without a row had no
    evidence. Resolved and decorative visuals are left alone, before any function runs on them.
    """
    state = F.coalesce("visual_state", F.lit(""))
    alt = F.get_json_object(F.coalesce("extra", F.lit("{}")), "$.alt") if "extra" in blocks.columns else F.lit("")
    work = blocks.where((F.col("type") == "visual") & ~state.isin(*RESOLVED, "ignored_decorative")).select("document_id", "block_id", alt.alias("alt"))
    ctx = with_context(blocks)
    known = results.groupBy("document_id", "block_id").agg(F.max(F.struct("confidence", "text")).alias("r"))
    rows = work.distinct().join(ctx, ["document_id", "block_id"], "left").join(known, ["document_id", "block_id"], "left")
    guess = classify_context(F.col("alt"), F.concat_ws("\n", "preceding", "following"))
    raw = F.col("r.text")
    blank = strip(F.coalesce(raw, F.lit(""))) == ""
    rows = rows.withColumn("guess", guess).withColumn("visual_type", F.when(blank, F.col("guess")).otherwise(classify_text(raw, F.col("guess"))))
    t = F.col("visual_type")
    by_context = F.when(F.col("guess").isin("http", "diff"), F.col("guess")).when(F.col("guess") == "terminal", "bash").when(F.col("guess").isin("log", "stack_trace"), "log")
    rows = rows.withColumn("language", F.when(~blank, F.coalesce(detect_language(raw, t), by_context))).withColumn("selected_text", F.when(blank, "").otherwise(repaired(raw, t)))
    split = F.size(F.filter(panels(F.col("selected_text"), t), lambda s: s["role"] == "command")) > 0
    conf = final_confidence(F.coalesce("r.confidence", F.lit(0.0)), F.when((t == "terminal") & split, 0.02).otherwise(0.0), F.lit(0))
    sure = (conf >= HIGH_CONFIDENCE) & ~looks_space_merged(F.col("selected_text"))
    new_state = F.when(F.col("r").isNull(), "failed").when(blank, "review_required").when(t == "decorative", "ignored_decorative").when(sure, "resolved_ocr").otherwise("review_required")
    coverage = F.when(new_state == "failed", "failed_with_diagnostic").when(new_state == "resolved_ocr", "transcribed").when(new_state == "ignored_decorative", "decorative_with_reason").otherwise("review_required")
    reason = F.when(new_state == "failed", "no evidence image available").when(blank, "recognition returned empty output").when(new_state == "review_required", "confidence below threshold").otherwise("recognized")
    return rows.select(
        "document_id", "block_id", "visual_type", new_state.alias("visual_state"), coverage.alias("coverage_state"), reason.alias("coverage_reason"), "language", "selected_text",
        conf.alias("confidence"), panels(F.col("selected_text"), t).alias("segments"),
    )


# ---- general vision ---------------------------------------------------------------------------------------------

# Visual types that a general vision model is asked about.
VLM_TYPES = ("diagram", "ui_screenshot", "unknown", "architecture_diagram", "flowchart", "chart", "multi_panel_instructional_image")


def routed_to_vlm(visual_type: Column, visual_state: Column) -> Column:
    """Whether a visual goes to a general vision model."""
    return visual_type.isin(*VLM_TYPES) & (F.coalesce(visual_state, F.lit("")) != "ignored_decorative")


def vlm_answer(body: Column) -> Column:
    """The object in a chat completion's first message, or the body itself, as visible text, summary and uncertainties."""
    content = F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), body)
    return F.from_json(content, "struct<visual_type:string,visible_text:array<string>,summary:string,uncertainties:array<string>>")


def without_keys(metadata: Column) -> Column:
    """A map of metadata without entries whose name contains ``key``."""
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).contains("key"))


def vlm_request(model: str, preceding: Column, following: Column, chars: int = 1000) -> Column:
    """Request for a visual with the last and first characters of the text around it, as JSON."""
    ask = F.concat(F.lit("Text before: "), F.substring(preceding, -chars, chars), F.lit("\nText after: "), F.substring(following, 1, chars))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), ask.alias("content"))).alias("messages")))
