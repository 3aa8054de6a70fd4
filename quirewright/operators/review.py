"""Review history: an append-only log of revisions, and views of the latest value of each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REVISION = "document_id string, block_id string, field string, old_value string, new_value string, user string, timestamp timestamp"
#: Block id of edits to the document as a whole.
DOCUMENT = "__document__"


def effective_revisions(edits: DataFrame) -> DataFrame:
    """Edits that changed a value, with the value they changed: (document_id, block_id, field, value, user, timestamp) in, revisions out."""
    w = W.partitionBy("document_id", "block_id", "field").orderBy("timestamp", "value")
    old = F.lag("value").over(w)
    return edits.withColumn("old_value", old).where(~F.col("value").eqNullSafe(F.col("old_value"))).select("document_id", "block_id", "field", "old_value", F.col("value").alias("new_value"), "user", "timestamp")


def latest_values(revisions: DataFrame) -> DataFrame:
    """(document_id, block_id, field, value): the newest value of each field; ties by value."""
    return revisions.groupBy("document_id", "block_id", "field").agg(F.max_by("new_value", F.struct("timestamp", "new_value")).alias("value"))


def review_state(revisions: DataFrame) -> DataFrame:
    """One row per document: its status, maps of verified blocks and corrections, notes."""
    last = latest_values(revisions)
    entry = lambda f: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("block_id", "value")))))
    one = lambda f: F.max(F.when((F.col("field") == f) & (F.col("block_id") == DOCUMENT), F.col("value")))
    return last.groupBy("document_id").agg(one("status").alias("status"), entry("verified").alias("verified"), entry("correction").alias("corrections"), one("notes").alias("notes"))


def with_corrections(blocks: DataFrame, revisions: DataFrame) -> DataFrame:
    """Blocks with ``shown_text``: the reviewer's correction if there is one, else the selected text."""
    fixes = latest_values(revisions).where((F.col("field") == "correction") & (F.col("value") != "")).select("document_id", "block_id", F.col("value").alias("correction"))
    joined = blocks.join(fixes, ["document_id", "block_id"], "left")
    return joined.withColumn("shown_text", F.coalesce("correction", "enrichment.selected_text", "text")).drop("correction")


def export_reviews(revisions: DataFrame) -> DataFrame:
    """(document_id, kind, body): one state row per document and all its revisions, as JSON."""
    state = review_state(revisions).select("document_id", F.lit("state").alias("kind"), F.to_json(F.struct("corrections", "notes", "status", "verified")).alias("body"))
    log = revisions.select("document_id", F.lit("revision").alias("kind"), F.to_json(F.struct("block_id", "field", "new_value", "old_value", "timestamp", "user")).alias("body"))
    return state.unionByName(log)
