"""Accuracy of a transcription against its gold text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.functions.code import strip_line_numbers, terminal_panels
from quirewright.functions.text import split_lines, strip

# Categories of punctuation.
PUNCTUATION = {
    "quotes": "'\"`", "brackets": "()[]{}<>", "slash_backslash": "/\\", "underscore_hyphen": "_-", "colon_semicolon": ":;",
    "equals": "=", "pipe": "|", "at": "@", "hash": "#", "dollar": "$",
}
# Characters that may stand for one another in a transcription, gold first; of several for one character the last that holds.
CONFUSABLE = {
    "0": "O", "O": "0", "1": "lI", "l": "1I", "I": "l1", "5": "S", "S": "5", "2": "Z", "Z": "2", "B": "8", "8": "B", "m": "rn", ".": ",", "；": ";", ";": "；", "，": ",", ",": "，",
    "（": "(", "(": "（", "）": ")", ")": "）", "　": " ", " ": "　", "\"": "''", "‘": "'", "’": "'", "“": "\"", "”": "\"",
}
URL, HASH = r"(https?://[^\s'\"<>)]+)", r"(?i)\b([a-f0-9]{32,64})\b"
LINE_NUMBER = r"(?U)^\s*\d+[\s.)\]]+"


def cer(gold: Column, actual: Column) -> Column:
    """Edit distance over the length of gold; for an empty gold 0 or 1."""
    return F.when(gold == "", F.when(actual == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(gold, actual) / F.length(gold))


def line_metrics(gold: Column, actual: Column) -> dict[str, Column]:
    """Lines equal in order; lines of one that are nowhere in the other, counted as often as they stand."""
    g, a = split_lines(gold), split_lines(actual)
    missing, extra = F.size(F.filter(g, lambda x: ~F.array_contains(a, x))), F.size(F.filter(a, lambda x: ~F.array_contains(g, x)))
    return {
        "exact_line_match": g == a, "gold_line_count": F.size(g), "actual_line_count": F.size(a), "missing_line_count": missing, "extra_line_count": extra,
        "missing_line_rate": missing / F.greatest(F.lit(1), F.size(g)), "extra_line_rate": extra / F.greatest(F.lit(1), F.size(a)),
    }


def indentation_accuracy(gold: Column, actual: Column) -> Column:
    """Share of line pairs, by position, with equal leading blanks; 1 without any pair."""
    g, a = split_lines(gold), split_lines(actual)
    n = F.least(F.size(g), F.size(a))
    width = lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1))
    same = F.size(F.filter(F.zip_with(F.slice(g, 1, n), F.slice(a, 1, n), lambda x, y: width(x) == width(y)), lambda x: x))
    return F.when(n == 0, 1.0).otherwise(same / F.greatest(n, F.lit(1)))


def _count_ratio(g: Column, a: Column) -> Column:
    return F.when(g == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(1 - F.abs(g - a) / F.greatest(g, a))


def punctuation_accuracy(gold: Column, actual: Column) -> dict[str, Column]:
    """Accuracy of the counts of each category of punctuation."""
    count = lambda c, marks: F.length(c) - F.length(F.translate(c, marks, ""))
    return {k: _count_ratio(count(gold, m), count(actual, m)) for k, m in PUNCTUATION.items()}


def digit_accuracy(gold: Column, actual: Column) -> Column:
    """Accuracy of the count of digits, superscripts and circled ones included."""
    digits = lambda c: F.regexp_count(c, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"))
    return _count_ratio(digits(gold), digits(actual))


def pattern_match(gold: Column, actual: Column, pattern: str) -> dict[str, Column]:
    """Whether the sets of matches are equal, and the share of gold's that is found; NULL where gold has none."""
    g = F.array_distinct(F.regexp_extract_all(gold, F.lit(pattern), F.lit(1)))
    a = F.array_distinct(F.regexp_extract_all(actual, F.lit(pattern), F.lit(1)))
    hit = F.size(F.array_intersect(g, a))
    there = F.size(g) > 0
    return {"exact": F.when(there, (hit == F.size(g)) & (F.size(a) == F.size(g))), "recall": F.when(there, hit / F.size(g))}


def critical_token_recall(actual: Column, tokens: Column) -> Column:
    """Share of the tokens that stand in the text, letter case aside; 1 without tokens."""
    known = F.coalesce(tokens, F.array().cast("array<string>"))
    hits = F.size(F.filter(known, lambda t: F.contains(F.lower(actual), F.lower(t))))
    return F.when(F.size(known) == 0, 1.0).otherwise(hits / F.size(known))


def line_number_removal(actual: Column) -> Column:
    """Share of numbered lines whose numbers the stripper takes; 1 without any."""
    count = lambda c: F.size(F.filter(split_lines(c), lambda x: x.rlike(LINE_NUMBER)))
    raw = count(actual)
    return F.when(raw == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - count(strip_line_numbers(actual)) / raw))


def segmentation_f1(gold: Column, actual: Column) -> Column:
    """F1 of the (role, line) pairs of commands and outputs; 1 where gold has no segment."""
    pairs = lambda c: F.array_distinct(F.flatten(F.transform(terminal_panels(c), lambda s: F.transform(split_lines(s["text"]), lambda x: F.struct(s["role"].alias("r"), x.alias("x"))))))
    g, a = pairs(gold), pairs(actual)
    tp = F.size(F.array_intersect(g, a))
    p, r = tp / F.greatest(F.lit(1), F.size(a)), tp / F.greatest(F.lit(1), F.size(g))
    return F.when(F.size(terminal_panels(gold)) == 0, 1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def hallucination_rate(gold: Column, actual: Column) -> Column:
    """Share of characters of the transcription that gold has nowhere, not even in a form easily confused."""
    chars = F.filter(F.split(actual, ""), lambda x: x != "")
    # what gold's characters may be taken for: gold with every confusable written behind it
    allowed = F.concat(gold, *[F.when(F.contains(gold, F.lit(k)), v).otherwise("") for k, v in CONFUSABLE.items()])
    blank = gold.rlike(r"(?U)\s")
    odd = F.size(F.filter(chars, lambda x: ~F.contains(allowed, x) & ~(blank & x.rlike(r"(?U)^\s$"))))
    return F.when(actual == "", 0.0).otherwise(odd / F.length(actual))


def same_stripped(gold: Column, actual: Column) -> Column:
    """Equal but for whitespace at the ends."""
    return strip(gold) == strip(actual)
