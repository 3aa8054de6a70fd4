"""Page states as a stream: each page's latest state, and progress per document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States of a page in the order in which it passes through them.
STATES = ("pending", "extracting", "native_extracted", "visuals_detected", "ocr_processing", "rendered", "verified", "failed")
OUT = "document_id string, page_number int, state string, updates long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the furthest state of a page; a verified page stays verified, a failed one stays failed unless it starts again."""
    name, updates = state.get if state.exists else ("pending", 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "state"], kind="stable")
    for s in rows["state"]:
        if s not in STATES:
            continue
        updates += 1
        if name == "verified" or (name == "failed" and s != "extracting"):
            continue
        name = s if s in ("failed", "extracting") or STATES.index(s) >= STATES.index(name) else name
    state.update((name, updates))
    yield pd.DataFrame([(key[0], int(key[1]), name, int(updates))], columns=["document_id", "page_number", "state", "updates"])


def page_states(events: DataFrame) -> DataFrame:
    """Streaming events (document_id, page_number, state, ts) to the state of each page, kept across batches and restarts."""
    return events.groupBy("document_id", "page_number").applyInPandasWithState(_advance, OUT, "state string, updates long", "update", GroupStateTimeout.NoTimeout)


def new_files(spark: SparkSession, path: str, schema: str, checkpoint: str, out: str, fmt: str = "parquet") -> None:
    """Process the files that arrived since the last call, once each, and stop: the checkpoint remembers them across failures."""
    stream = spark.readStream.schema(schema).format(fmt).load(path)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def distinct_captures(captures: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream of captures without repeats of (canonical_source, captured_at) that arrive within ``delay`` of each other."""
    return captures.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["canonical_source", "captured_at"])


def captures_by_day(captures: DataFrame, delay: str = "14 days") -> DataFrame:
    """Captures a day and source type, late ones within ``delay`` included."""
    return captures.withWatermark("captured_at", delay).groupBy(F.window("captured_at", "1 day"), "source_type").agg(F.count(F.lit(1)).alias("captures"))
