"""Full-text search by term frequency, and the dashboard's filters over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.functions.text import search_tokens, strip, title_of

PAGE_SIZE = 50


def search_corpus(blocks: DataFrame, manifests: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """(document_id, title, full_text): rendered text, blocks, transcriptions and identifiers of each document; a text that stands in several fields counts in each."""
    parts = F.concat_ws("\n", "text", "enrichment.selected_text", "enrichment.raw_text")
    texts = blocks.where(parts != "").select("document_id", "block_order", "block_id", parts.alias("t")).distinct()
    joined = texts.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "t"))), lambda s: s["t"]), "\n").alias("body"))
    ids = manifests.groupBy("document_id").agg(F.min("source").alias("source"), F.min("canonical_source").alias("canonical_source"))
    out = joined.join(ids, "document_id", "left")
    if markdown is not None:
        out = out.join(markdown, "document_id", "left")
        title, md = F.coalesce(title_of(F.col("markdown")), F.col("document_id")), F.col("markdown")
    else:
        title, md = F.col("document_id"), F.lit(None).cast("string")
    return out.select("document_id", title.alias("title"), F.concat_ws("\n", md, "body", "source", "canonical_source", "document_id").alias("full_text"))


def postings(corpus: DataFrame) -> DataFrame:
    """(document_id, token, tf): the inverted index. Counting combines before the shuffle and is keyed by (document, token), so no document or token is one task's."""
    return corpus.select("document_id", F.explode(search_tokens(F.col("full_text"))).alias("token")).groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def _query_tokens(spark, query: str) -> list[str]:
    return spark.range(1).select(search_tokens(F.lit(query)).alias("t")).first()[0]


def search(corpus: DataFrame, query: str, limit: int = 100, index: DataFrame | None = None) -> DataFrame:
    """(document_id, title, score) of the best documents: summed term frequency of the query's tokens, repeats included, or occurrences of a quoted phrase.

    Ties are broken by document_id. An empty query finds nothing.
    """
    tokens = _query_tokens(corpus.sparkSession, query)
    q = query.strip()
    if not tokens:
        return corpus.select("document_id", "title", F.lit(0.0).alias("score")).limit(0)
    if len(q) >= 2 and q[0] == q[-1] == '"':
        phrase = q[1:-1].lower()
        low = F.lower("full_text")
        hits = (F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / F.lit(max(1, len(phrase)))
        scored = corpus.where(low.contains(phrase)).select("document_id", "title", hits.cast("double").alias("score"))
    else:
        weight = {t: tokens.count(t) for t in tokens}
        if index is None:
            # no index: count in place, without exploding what is not asked for
            found = F.filter(search_tokens(F.col("full_text")), lambda t: t.isin(*weight))
            times = lambda word: F.size(F.filter("f", lambda x: x == word))
            score = sum((times(t) * n for t, n in weight.items()), F.lit(0))
            scored = corpus.withColumn("f", found).where(F.size("f") > 0).select("document_id", "title", score.cast("double").alias("score"))
        else:
            asked = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])
            sums = index.where(F.col("token").isin(*weight)).groupBy("document_id").agg(F.sum(F.col("tf") * F.element_at(asked, F.col("token"))).cast("double").alias("score"))
            scored = sums.join(corpus.select("document_id", "title"), "document_id")
    return scored.orderBy(F.desc("score"), "document_id").limit(limit)


# ---- dashboard --------------------------------------------------------------------------------------------------


def document_index(manifests: DataFrame, blocks: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """One row per document: its newest manifest, number of blocks and, if given, its counts of unresolved visuals."""
    newest = manifests.groupBy("document_id").agg(F.max(F.struct("captured_at", "status", "source_type", "source", "canonical_source")).alias("m"))
    counts = blocks.groupBy("document_id").agg(F.count_distinct("block_id").alias("block_count"))
    out = newest.select("document_id", "m.*").join(counts, "document_id", "left").na.fill(0, ["block_count"])
    return out if unresolved is None else out.join(unresolved, "document_id", "left")


def filtered_index(
    index: DataFrame, blocks: DataFrame, statuses: list[str] | None = None, source_types: list[str] | None = None, coverage: list[str] | None = None, confidence: tuple[float, float] = (0.0, 1.0), hits: DataFrame | None = None
) -> DataFrame:
    """The index under the dashboard's filters: cheap ones on the index first, EXISTS over visual blocks as semi joins, search hits as a semi join on document_id."""
    out = index
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if source_types:
        out = out.where(F.col("source_type").isin(*source_types))
    visual = blocks.where("type = 'visual'")
    if coverage:
        out = out.join(visual.where(F.col("coverage_state").isin(*coverage)).select("document_id"), "document_id", "left_semi")
    if confidence != (0.0, 1.0):
        c = F.coalesce("enrichment.confidence", F.lit(0.0))
        out = out.join(visual.where(c.between(*confidence)).select("document_id"), "document_id", "left_semi")
    return out if hits is None else out.join(hits.select("document_id"), "document_id", "left_semi")


# Orders that the dashboard offers.
SORTS = {"document_id": ["+document_id"], "status": ["+status", "+document_id"], "captured_at": ["-captured_at", "+document_id"], "visual_count": ["-block_count", "+document_id"]}


def page_of(index: DataFrame, sort: str = "document_id", page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the index in one of the offered orders."""
    keys = [F.desc_nulls_last(k[1:]) if k[0] == "-" else F.asc(k[1:]) for k in SORTS[sort]]
    return index.orderBy(*keys).offset(page * size).limit(size)


def visual_list(blocks: DataFrame, states: list[str] | None = None, confidence: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Visual blocks of documents under the reviewer's filters; a missing confidence is 0."""
    c = F.coalesce("enrichment.confidence", F.lit(0.0))
    out = blocks.where((F.col("type") == "visual") & c.between(*confidence))
    out = out.where(F.col("visual_state").isin(*states)) if states else out
    return out.select("document_id", "block_order", "block_id", "visual_type", "visual_state", c.alias("confidence"))


def status_counts(index: DataFrame) -> DataFrame:
    """Documents by status."""
    return index.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def preview(blocks: DataFrame, length: int = 60) -> DataFrame:
    """Blocks with the start of their text on one line."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    return blocks.select("document_id", "block_order", "block_id", "type", F.substring(strip(flat), 1, length).alias("preview"))


def last_n(log: DataFrame, keys: list[str], order: list[Column], n: int = 10) -> DataFrame:
    """The newest rows of each key."""
    return log.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
