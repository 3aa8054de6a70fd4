"""Sinks: tables that can be rewritten by partition, ledgers as JSON, one Markdown file per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import shared_dir  # noqa: F401  (the folder that staged output goes to)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; with partitions only those in ``df`` are replaced, so a repeated run gives the same table."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_ledger(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").json(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """One folder per document (document_id, markdown) with its text: the file commit protocol publishes all or none."""
    documents.select("document_id", F.col("markdown").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").text(path)


def unique_assets(images: DataFrame) -> DataFrame:
    """Images kept once per content."""
    return images.dropDuplicates(["content_sha256"])
