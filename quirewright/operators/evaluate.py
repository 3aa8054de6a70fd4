"""Evaluation of transcriptions against a golden set: metrics per sample, aggregates, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.functions import metrics as M
from quirewright.functions.code import classify_text, detect_language

# Languages that may stay undetected, and the gates of calibration.
SOFT_LANGUAGES = ("http", "diff", "log", "yaml", "json", "ini", "toml")
CER_GATE = 0.05


def sample_metrics(pairs: DataFrame) -> DataFrame:
    """All measures of each (sample_id, visual_type, language, critical_tokens, line_numbers_present, gold, actual, confidence): one projection."""
    g, a = F.coalesce("gold", F.lit("")), F.coalesce("actual", F.lit(""))
    predicted = classify_text(a, "unknown")
    # a label outside the known types is read as an unknown type
    kind = F.when(F.col("visual_type").isin("code", "terminal", "http", "diff", "configuration", "log", "stack_trace", "table", "diagram", "ui_screenshot", "decorative"), F.col("visual_type")).otherwise("unknown")
    lang = detect_language(a, kind)
    cer = M.cer(g, a)
    line, url, digest, punct = M.line_metrics(g, a), M.pattern_match(g, a, M.URL), M.pattern_match(g, a, M.HASH), M.punctuation_accuracy(g, a)
    return pairs.select(
        "sample_id", F.coalesce("visual_type", F.lit("other")).alias("visual_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), cer.alias("cer"), F.greatest(F.lit(0.0), 1 - cer).alias("char_accuracy"),
        M.same_stripped(g, a).alias("exact_match"), line["exact_line_match"].alias("exact_line_match"), line["missing_line_rate"].alias("missing_line_rate"), line["extra_line_rate"].alias("extra_line_rate"),
        (M.indentation_accuracy(g, a) == 1.0).alias("indentation_exact_match"), M.indentation_accuracy(g, a).alias("leading_whitespace_accuracy"),
        *[c.alias(f"punct_{k}") for k, c in punct.items()], M.digit_accuracy(g, a).alias("digit_accuracy"), url["exact"].alias("url_exact"), digest["exact"].alias("hash_exact"),
        M.critical_token_recall(a, F.col("critical_tokens")).alias("critical_token_recall"), (F.size(F.coalesce("critical_tokens", F.array().cast("array<string>"))) > 0).alias("has_critical"),
        F.coalesce(predicted == F.col("visual_type"), F.lit(False)).alias("visual_type_correct"),
        (lang.eqNullSafe(F.col("language")) | F.coalesce(F.col("language").isin(*SOFT_LANGUAGES) & lang.isNull(), F.lit(False))).alias("language_correct"),
        F.when(F.col("visual_type") == "terminal", M.segmentation_f1(g, a)).alias("segmentation_f1"),
        F.when(F.coalesce("line_numbers_present", F.lit(False)), M.line_number_removal(a)).alias("line_number_removal"), M.hallucination_rate(g, a).alias("hallucination_rate"),
    )


def _aggregates() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return [
        F.count(F.lit(1)).alias("sample_count"), F.avg("cer").alias("cer_mean"), F.min("cer").alias("cer_min"), F.max("cer").alias("cer_max"), F.avg("char_accuracy").alias("char_accuracy_mean"),
        share("exact_match").alias("exact_match_rate"), share("exact_line_match").alias("exact_line_match_rate"), F.avg("missing_line_rate").alias("missing_line_rate_mean"), F.avg("extra_line_rate").alias("extra_line_rate_mean"),
        share("indentation_exact_match").alias("indentation_exact_match_rate"), F.avg("leading_whitespace_accuracy").alias("leading_whitespace_accuracy_mean"),
        *[F.avg(f"punct_{k}").alias(f"punct_{k}") for k in M.PUNCTUATION], F.avg("digit_accuracy").alias("digit_accuracy_mean"), F.avg("critical_token_recall").alias("critical_token_recall_mean"),
        share("visual_type_correct").alias("visual_type_accuracy"), share("language_correct").alias("language_accuracy"), F.avg("segmentation_f1").alias("segmentation_f1_mean"),
        F.avg("line_number_removal").alias("line_number_removal_mean"), share("url_exact").alias("url_exact_rate"), share("hash_exact").alias("hash_exact_rate"), F.avg("hallucination_rate").alias("hallucination_rate_mean"),
    ]


def aggregate(metrics: DataFrame) -> DataFrame:
    """Means over all samples (visual_type ``all``) and by visual type, in one pass; measures that apply to no sample are NULL."""
    rolled = metrics.rollup("visual_type").agg(*_aggregates(), F.grouping("visual_type").alias("g"))
    return rolled.withColumn("visual_type", F.when(F.col("g") == 1, "all").otherwise(F.col("visual_type"))).drop("g")


def calibrate(metrics: DataFrame, thresholds: list[tuple[float, float]]) -> DataFrame:
    """One row per (low, high): samples accepted, in review and rejected by confidence, and how often the gate of accuracy disagrees.

    All thresholds are read in one pass as conditional aggregates; each sample is repeated for every pair of that short list.
    """
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in thresholds])
    ok = (F.col("cer") <= CER_GATE) & (~F.col("has_critical") | (F.col("critical_token_recall") >= 1.0))
    c = F.col("confidence")
    accepted, review, rejected = c >= F.col("high"), (c >= F.col("low")) & (c < F.col("high")), c < F.col("low")
    by = metrics.select("cer", "confidence", ok.alias("ok"), F.inline(pairs)).groupBy("low", "high").agg(
        F.count_if(accepted).alias("accepted_count"), F.count_if(review).alias("review_count"), F.count_if(rejected).alias("rejected_count"),
        F.count_if(accepted & ~F.col("ok")).alias("false_accept_count"), F.count_if(review & F.col("ok")).alias("false_review_count"),
        F.avg(F.when(accepted, F.col("cer"))).alias("accepted_mean_cer"), F.avg(F.when(review, F.col("cer"))).alias("review_mean_cer"), F.avg(F.when(rejected, F.col("cer"))).alias("rejected_mean_cer"),
    )
    rate = lambda n, d: F.col(n) / F.greatest(F.lit(1), F.col(d))
    return by.withColumns(
        {
            "accepted_precision": 1 - rate("false_accept_count", "accepted_count"), "review_precision": 1 - rate("false_review_count", "review_count"),
            "false_accept_rate": rate("false_accept_count", "accepted_count"), "false_review_rate": rate("false_review_count", "review_count"),
        }
    )


def pair_up(golden: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, errors): golden samples with their transcriptions (sample_id, actual, confidence), and samples without one."""
    g = golden.select("sample_id", "visual_type", "language", "critical_tokens", "line_numbers_present", F.col("gold_verbatim").alias("gold"))
    return g.join(results, "sample_id"), golden.join(results, "sample_id", "left_anti").select("sample_id")


def report_markdown(aggregates: DataFrame) -> DataFrame:
    """One row: the aggregates as a Markdown table, overall first. Its size is that of the set of visual types."""
    line = F.format_string("| %s | %d | %.4f | %.4f | %.4f |", "visual_type", "sample_count", "cer_mean", "exact_match_rate", "critical_token_recall_mean")
    rows = aggregates.select(F.struct((F.col("visual_type") != "all").alias("later"), "visual_type", line.alias("line")).alias("r"))
    head = "| type | n | CER | exact | critical |\n| --- | --- | --- | --- | --- |\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")).alias("markdown"))
