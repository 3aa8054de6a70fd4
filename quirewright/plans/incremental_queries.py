"""Query of the incremental step over captures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.cluster import shared_dir, table
from quirewright.streaming.incremental import CommitLog, captures_to_process, captures_waiting


class _BreaksOff(Exception):
    """Ends a run on purpose."""


def _log(spark: SparkSession) -> CommitLog:
    """A log of its own under the folder that ``release`` deletes."""
    return CommitLog(spark, f"{shared_dir(spark)}/quirewright/{spark.sparkContext.applicationId}/incremental-{uuid.uuid4().hex}")


def _break_off() -> None:
    raise _BreaksOff


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Captures that the next run must process, after three runs: one up to the middle of the ingest times, one over the rest that breaks off before its commit, and one more."""
    log, manifests, state = _log(spark), table(spark, d, "manifests"), table(spark, d, "batch_state")
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    middle = manifests.agg(F.date_format(F.timestamp_micros(((F.min(at) + F.max(at)) / 2).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
    captures_to_process(log, manifests, state, until=middle)
    try:
        captures_to_process(log, manifests, state, _break_off)
    except _BreaksOff:
        pass
    captures_to_process(log, manifests, state)
    return captures_waiting(log)


def late_captures(spark: SparkSession, d: str) -> DataFrame:
    """The same where rows come late: a first run lacks every third row, and those without an ingest time, and all of them lie below its watermark when they come."""
    log, manifests, state = _log(spark), table(spark, d, "manifests"), table(spark, d, "batch_state")
    newest = manifests.agg(F.max("ingested_at")).first()[0]
    early = F.col("ingested_at").isNotNull() & ((F.pmod(F.xxhash64("canonical_source", "captured_at"), F.lit(3)) > 0) | (F.col("ingested_at") == F.lit(newest)))
    captures_to_process(log, manifests.where(early), state)
    captures_to_process(log, manifests, state)
    return captures_waiting(log)


QUERIES = {"p7_found": p7_found, "late_captures": late_captures}

SQL = {
    "p7_found": r"""
with m as (
  select canonical_source, captured_at, ingested_at, document_id,
         nullif(regexp_replace(lower(trim(content_sha256)), '^sha256:\s*', ''), '') as content,
         nullif(regexp_replace(lower(trim(config_sha256)), '^sha256:\s*', ''), '') as config
  from manifests),
newest as (
  select * from m where canonical_source is not null and content is not null and config is not null
  qualify row_number() over (partition by canonical_source order by captured_at desc nulls last, ingested_at desc nulls last, document_id desc) = 1),
done as (
  select source_key, nullif(regexp_replace(lower(trim(content_sha256)), '^sha256:\s*', ''), '') as content,
         nullif(regexp_replace(lower(trim(config_sha256)), '^sha256:\s*', ''), '') as config
  from batch_state where status in ('accepted', 'review', 'rejected')
  qualify row_number() over (partition by source_key order by captured_at desc nulls last, attempts desc nulls last) = 1)
select distinct n.canonical_source, n.document_id from newest n left join done d on d.source_key = n.canonical_source
where d.source_key is null or n.content is distinct from d.content or n.config is distinct from d.config
"""
}
SQL["late_captures"] = SQL["p7_found"]
