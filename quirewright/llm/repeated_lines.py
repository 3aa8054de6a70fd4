"""Lines repeated across one site's documents (problem 1).

Method: content-defined chunking with a rolling hash. A block's text, each line reduced to its letters, is cut into chunks by
a gear hash whatever lines there are: a line end is a byte like any other. Distinct documents are counted per (site, chunk), and chunks that
stand in at least ``min_share`` of the site's documents are cut. The result is asked for by line, so cuts are mapped back to lines: a
line is a candidate if all chunks wholly inside it are cut. Those depend on the line alone, so no repeated line is
lost, whatever stands around it; a line too short to hold a whole chunk (half of all repeated lines have ten letters at most) can't be ruled out by
chunks. An exact count of the candidate lines follows, as a chunk that joins two lines would tie a notice to its neighbours.

Scale: one pass over the text; what is shuffled is 64-bit hashes. Counts are pre-aggregated and hashed by
(site, chunk, document), so a site that holds a third of all rows is spread over all tasks; lookups by
site or document are broadcast behind a size check and salted otherwise.

Cases: NULL or blank text has no lines; a document whose rows all lack a reference has no site and
no cases; repeated rows and repeated lines within a document count once; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import key_join, lookup_join, materialize

# Names of months in English, German, French and Spanish, long and short forms.
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "januar februar märz mai juni juli oktober dezember okt dez "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre janv févr avr juil déc "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre ene abr ago dic"
).split()
#: Types of block whose lines count.
LINE_TYPES = ("paragraph", "list", "quote")
WEB = ("url", "html")

_M = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")(?![\p{L}])\.?"
_ORD = r"(?:st|nd|rd|th|er|º|ª)?"
_DATE = (
    rf"\d{{1,4}}{_ORD}[\s.,]*(?:(?:de|of|del)\s+)?(?<![\p{{L}}]){_M}(?:[\s.,]*(?:(?:de|of|del)\s+)?\d{{1,4}})?"
    rf"|(?<![\p{{L}}]){_M}[\s.,]*(?:(?:de|of|del)\s+)?\d{{1,4}}(?:st|nd|rd|th)?"
)


def line_key(line: Column) -> Column:
    """A line without what may differ: letter case, whitespace, punctuation, numbers and dates."""
    low = F.lower(line)
    dated = F.when(low.rlike(r"\d"), F.regexp_replace(F.regexp_replace(low, _DATE, " "), r"\d+(?:st|nd|rd|th)(?![\p{L}])", " ")).otherwise(low)
    return F.regexp_replace(dated, r"[^\p{L}\p{M}]+", "")


def host(ref: Column) -> Column:
    """Host of a reference, in lower case, without scheme, user, port and a leading ``www.``; NULL if there is none."""
    h = F.lower(F.regexp_extract(F.trim(ref), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.lower(F.regexp_extract(F.trim(ref), r"^([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?:[:/?#]|$)", 1))
    h = F.when(h != "", h).when(bare != "", bare)
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def site_of_documents(web: DataFrame) -> DataFrame:
    """(document_id, site): the host that any row of the document tells."""
    return web.groupBy("document_id").agg(F.max(host(F.col("provenance_source_ref"))).alias("site")).where("site is not null and document_id is not null")


def _chunked(batches):
    import pyarrow as pa

    from quirewright.llm.hashing import chunked

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *chunked(b.column(2))], names=["document_id", "block_id", "chunks", "lines"])


def chunked_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, chunks, lines): hashes of the chunks of every block with a letter, and its lines with the chunks inside them."""
    from quirewright.llm.hashing import NO_LINE

    keys = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(r"\p{L}"), line_key(x)).otherwise(F.lit(NO_LINE)))
    rows = blocks.where(F.col("source_kind").isin(*WEB) & F.col("type").isin(*LINE_TYPES) & F.col("text").rlike(r"\p{L}"))
    return rows.select("document_id", "block_id", F.array_join(keys, "\n").alias("keys")).mapInArrow(
        _chunked, "document_id string, block_id string, chunks array<long>, lines array<struct<no:int,line:long,inside:array<long>>>"
    )


def repeated_lines(blocks: DataFrame, min_share: float = 0.25, min_documents: int = 5) -> DataFrame:
    """(document_id, block_id, line_no, site): lines that stand in ``min_share`` of the documents of a site of at least ``min_documents``."""
    web = blocks.where(F.col("source_kind").isin(*WEB))
    sites = materialize(site_of_documents(web), "sites")
    totals = materialize(
        sites.groupBy("site").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= min_documents), "totals"
    )
    cut = lookup_join(materialize(chunked_blocks(blocks), "chunked"), sites, ["document_id"], spread=["block_id"], materialized=True)
    enough = F.col("n") >= F.col("documents") * min_share

    counts = (
        cut.select("site", F.explode(F.array_distinct("chunks")).alias("chunk"), F.xxhash64("document_id").alias("d"))
        .distinct()
        .groupBy("site", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    repeated = materialize(lookup_join(counts, totals, ["site"], materialized=True).where(enough).select("site", "chunk"), "repeated")

    keys = ["site", "document_id", "block_id", "line_no", "line"]
    lines = cut.select("site", "document_id", "block_id", F.explode("lines").alias("l")).select("site", "document_id", "block_id", F.col("l.no").alias("line_no"), F.col("l.line").alias("line"), "l.inside")
    short = lines.where(F.size("inside") == 0)
    first = lines.where(F.size("inside") > 0).withColumn("chunk", F.element_at("inside", 1))
    maybe = lookup_join(first, repeated, ["site", "chunk"], spread=["document_id", "block_id"], materialized=True)
    maybe = materialize(maybe.select(*keys, "inside"), "maybe")
    one = maybe.where(F.size("inside") == 1)
    long = maybe.where(F.size("inside") > 1).withColumn("chunk", F.explode(F.array_distinct(F.slice("inside", 2, 1 << 30))))
    long = lookup_join(long, repeated.withColumn("hit", F.lit(1)), ["site", "chunk"], "left", spread=["document_id", "block_id"], materialized=False)
    long = long.groupBy(*keys).agg(F.min(F.coalesce("hit", F.lit(0))).alias("all")).where("all = 1")
    candidates = short.select(*keys).unionByName(one.select(*keys)).unionByName(long.select(*keys))

    lines_n = candidates.select("site", "line", "document_id").distinct().groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    exact = lookup_join(lines_n, totals, ["site"], materialized=True).where(enough).select("site", "line")
    return lookup_join(candidates, exact, ["site", "line"], spread=["document_id", "block_id"]).select("document_id", "block_id", "line_no", "site").distinct()


def without_repeated_lines(blocks: DataFrame, min_share: float = 0.25, min_documents: int = 5) -> DataFrame:
    """``blocks`` with two columns more: ``clean_text``, the text without its repeated lines, and ``removed_lines``, their numbers.

    Text in which nothing is removed stays as it is, NULL included.
    """
    gone = repeated_lines(blocks, min_share, min_documents).groupBy("document_id", "block_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    base = blocks.drop("removed_lines", "clean_text")
    out = key_join(base, gone, ["document_id", "block_id"], "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda s: ~F.array_contains(F.col("removed_lines"), s.n))
    hit = F.col("removed_lines").isNotNull() & F.col("source_kind").isin(*WEB) & F.col("type").isin(*LINE_TYPES)
    return out.withColumn("clean_text", F.when(hit, F.array_join(F.transform(kept, lambda s: s.x), "\n")).otherwise(F.col("text"))).withColumn(
        "removed_lines", F.when(hit, F.col("removed_lines")).otherwise(F.array().cast("array<int>"))
    )
