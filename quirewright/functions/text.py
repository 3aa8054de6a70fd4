"""Scalar text functions as column expressions; Arrow UDFs only for NFC and diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line for ``splitlines``, as a pattern.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SLUG_LENGTH, SHORT_HASH = 40, 8
# Forms of image references.
IMAGE_MARKDOWN = r"!\[[^\]]*\]\([^)]*\)"
IMAGE_HTML = r"(?i)<\s*img\b[^>]*>"
IMAGE_BASE64 = r"(?i)data:image/[^;]+;base64"


def strip(c: Column) -> Column:
    """Without whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    """Without whitespace at the end."""
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip(c: Column) -> Column:
    """Without whitespace at the start."""
    return F.regexp_replace(c, r"(?U)^\s+", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no line, empty text has none."""
    parts = F.split(c, LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def unix_lines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def nfc(c: Column) -> Column:
    """Canonical composition; ASCII texts are passed through as they are."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFC")

    return F.when(c.rlike(r"[^\x00-\x7f]"), run(c)).otherwise(c)


def normal_text(c: Column) -> Column:
    """NFC with LF line ends."""
    return unix_lines(nfc(c))


def collapse(c: Column) -> Column:
    """Lower case, whitespace runs as one space, none at the ends: the form in which texts are compared for duplicates."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


# ---- identity ---------------------------------------------------------------------------------------------------


def source_type(source: Column) -> Column:
    """``url``, ``pdf`` or ``html`` by scheme or suffix; NULL where it can't be told."""
    low = F.lower(source)
    return F.when(low.rlike(r"^(https?|file)://"), "url").when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.html?$"), "html")


def canonical_source(source: Column) -> Column:
    """A URL with lower-case scheme and host, without fragment and one trailing slash; anything else as it is."""
    scheme = F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(source, r"^[^?#]*(\?[^#]*)", 1)
    query = F.when(query == "?", "").otherwise(query)
    return F.when(
        F.lower(scheme).isin("http", "https") & (host != ""),
        F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.regexp_replace(path, "/$", ""), query),
    ).otherwise(source)


def document_id(canonical: Column, content_sha256: Column, config_sha256: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the three parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", canonical, content_sha256, config_sha256), 256), 1, 16)


def block_id(number: Column) -> Column:
    """``b_`` and the number in six digits."""
    return F.format_string("b_%06d", number)


def slug(source: Column, kind: Column) -> Column:
    """Name for a folder: host and last path segment of a URL, stem of a file; ASCII, hyphens, at most 40 characters."""
    host = F.regexp_replace(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"www\.", "")
    path = F.regexp_replace(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    url = F.when(last == "", host).otherwise(F.concat_ws("-", host, last))
    name = F.regexp_extract(F.regexp_replace(source, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    base = F.when(F.lower(kind).isin("url", "web"), url).otherwise(stem)
    words = F.lower(F.regexp_replace(F.regexp_replace(base, r"(?i)\.(pdf|html?)$", ""), r"[^a-zA-Z0-9]+", "-"))
    cut = F.regexp_replace(F.regexp_replace(words, r"^-|-$", ""), "^$", "")
    short = F.when(F.length(cut) > SLUG_LENGTH, F.regexp_replace(F.substring(cut, 1, SLUG_LENGTH), "-+$", "")).otherwise(cut)
    return F.when(short == "", "doc").otherwise(short)


def folder_name(source: Column, kind: Column, content_sha256: Column) -> Column:
    """Slug and the first eight digits of the content's hash."""
    head = F.substring(F.coalesce(content_sha256, F.lit("")), 1, SHORT_HASH)
    return F.concat_ws("-", slug(source, kind), F.when(head == "", "0" * SHORT_HASH).otherwise(head))


# ---- search and titles ------------------------------------------------------------------------------------------


def search_tokens(c: Column) -> Column:
    """Lower-case tokens: the ASCII words of each chunk between blanks, or the chunk itself where it has none."""
    chunks = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")
    words = lambda x: F.regexp_extract_all(x, F.lit(r"([a-z0-9_\-]+)"), F.lit(1))
    return F.flatten(F.transform(chunks, lambda x: F.when(F.size(words(x)) == 0, F.array(x)).otherwise(words(x))))


def title_of(markdown: Column) -> Column:
    """The first heading or first line that opens no fence, at most 200 characters; NULL if there is none."""
    lines = F.filter(F.transform(split_lines(markdown), strip), lambda x: (x != "") & ~x.startswith("```"))
    first = F.when(F.size(lines) > 0, F.element_at(lines, 1))
    return F.substring(F.when(first.startswith("# "), strip(F.substring(first, 3, 1 << 20))).otherwise(first), 1, 200)


# ---- images and fences ------------------------------------------------------------------------------------------


def strip_image_references(markdown: Column) -> Column:
    """Without Markdown images, HTML image tags and embedded image data."""
    out = F.regexp_replace(F.regexp_replace(markdown, IMAGE_MARKDOWN, ""), IMAGE_HTML, "")
    return F.regexp_replace(out, IMAGE_BASE64, "[removed-base64-image]")


def count_image_references(markdown: Column) -> Column:
    """Number of image references of the three forms."""
    return sum((F.regexp_count(markdown, F.lit(p)) for p in (IMAGE_MARKDOWN, IMAGE_HTML, IMAGE_BASE64)), F.lit(0))


def code_fence(text: Column, language: Column) -> Column:
    """A fenced block whose fence is longer than any run of backticks in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.coalesce(language, F.lit("")), F.lit("\n"), F.regexp_replace(text, r"\n+$", ""), F.lit("\n"), fence)


def unclosed_fence(markdown: Column, strict: bool = True) -> Column:
    """1 if a fence is open at the end, else 0, folded over the lines.

    ``strict`` follows the rule of the document check (a closing fence is bare and starts its line); otherwise that of the
    full-document check, where fences may be indented.
    """
    lines = F.split(markdown, "\n") if strict else F.transform(split_lines(markdown), strip)
    fences = F.filter(lines, lambda x: x.rlike(r"(?s)^`{3,}(\s*\S.*)?$" if strict else "^`{3}"))
    ticks = lambda x: F.length(F.regexp_extract(x, "^(`+)", 1))
    bare = lambda x: x.rlike("^`+$")
    step = lambda acc, x: F.when(acc == 0, ticks(x)).when(bare(x) & (ticks(x) >= acc), F.lit(0)).otherwise(acc)
    return F.aggregate(fences, F.lit(0), step, lambda acc: F.when(acc > 0, 1).otherwise(0))


# ---- odds and ends ----------------------------------------------------------------------------------------------


def chat_answer(c: Column) -> Column:
    """What follows the last marker of an assistant's turn, by the first marker that occurs."""
    after = lambda m: strip(F.substring_index(c, m, -1))
    return F.when(c.contains("Assistant:"), after("Assistant:")).when(c.contains("assistant:"), after("assistant:")).when(c.contains("<|assistant|>"), after("<|assistant|>")).otherwise(strip(c))


def text_regions(c: Column) -> Column:
    """Non-blank lines as regions without a box and with confidence 0."""
    kept = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.transform(kept, lambda x: F.struct(F.array().cast("array<double>").alias("bbox"), x.alias("text"), F.lit(0.0).alias("confidence")))


def unified_diff(before: Column, after: Column) -> Column:
    """Unified diff of two texts, without line ends after the headers."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import difflib

        for a, b in batches:
            yield pd.Series(
                ["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "raw", "corrected", lineterm="")) for x, y in zip(a, b)], dtype=object
            )

    return run(before, after)


def image_format(content: Column) -> Column:
    """Format of image bytes by their first bytes; ``data-uri`` and ``unknown`` included."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when((F.substring(head, 9, 8) == "66747970") & (F.substring(head, 17, 8).isin("61766966", "61766973")), "avif")
        .when(text.startswith("data:image/"), "data-uri")
        .when(text.rlike(r"(?is)^\s*(?:<\?xml.*?)?<svg"), "svg")
        .otherwise("unknown")
    )


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI."""
    return F.unbase64(F.substring_index(uri, ",", -1))
