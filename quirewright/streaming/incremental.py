"""Processing only new or changed records (problem 7).

Method: a high watermark on a monotonic commit sequence. A run reads the watermark of the last commit,
fixes its upper limit at the start, processes what lies between, and commits its output together with
the new watermark by one atomic rename. A run that breaks off leaves files that no commit names, so
nothing is skipped and nothing appears twice; of two runs at once only one can take a sequence number.

The sequence is whatever the source assigns when a row becomes visible (here ``ingested_at``); captures may
arrive long after they were taken, so the time of capture could not serve as one. A source may still deliver rows late: at or below the
watermark, or without any sequence value. Each commit therefore keeps a fingerprint (count and hash sums) of every day's rows and the hashes of the rows it took; a
day below the watermark whose fingerprint has changed is read again, and those of its rows that no commit took are new. A row delivered
twice is not new.

Scale: keys are reduced by partial aggregates (a source with a third of all rows costs no more), the join
is between one row per source on either side. A run without late rows reads the source once more for its fingerprint, a few numbers
a day; only days that changed are compared with the hashes taken.

Cases: a table without new or late rows makes no commit, unless sources left unfinished are to be taken up; rows without a sequence value form a day of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States of a source whose work is done.
FINISHED = ("accepted", "review", "rejected")


@dataclass(frozen=True)
class Commit:
    """One committed run: its number, the sequence it covers (low, high], and where its output, the hashes of the rows it took and the days' fingerprints lie."""

    number: int
    low: str | None
    high: str | None
    path: str
    rows: int
    taken: str | None = None
    days: str | None = None


class CommitLog:
    """A folder of numbered commits and the data they name, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def commits(self) -> list[Commit]:
        """All commits in order."""
        folder = self._path(f"{self.root}/_commits")
        fs = self._fs(folder)
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = []
        for n in names:
            stream = fs.open(self._path(f"{self.root}/_commits/{n}"))
            try:
                out.append(Commit(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            finally:
                stream.close()
        return out

    def last(self) -> Commit | None:
        """The newest commit."""
        got = self.commits()
        return got[-1] if got else None

    def commit(self, entry: Commit) -> None:
        """Publish a commit by one rename that fails if its number is taken."""
        temp = self._path(f"{self.root}/_staging/{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/_commits/{entry.number:012d}.json")
        fs = self._fs(final)
        fs.mkdirs(final.getParent())
        stream = fs.create(temp, False)
        stream.write(bytearray(json.dumps(asdict(entry)).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        context.rename(temp, final, options)

    def committed(self) -> DataFrame | None:
        """The output of all commits; None before the first."""
        paths = [c.path for c in self.commits()]
        return self.spark.read.parquet(*paths) if paths else None

    def current(self, *key: str) -> DataFrame | None:
        """Of the output of all commits, the rows of the last commit that has any for their ``key``; None before the first."""
        runs = [self.spark.read.parquet(c.path).withColumn("__run", F.lit(c.number)) for c in self.commits()]
        if not runs:
            return None
        whole = reduce(DataFrame.unionByName, runs)
        return whole.withColumn("__last", F.max("__run").over(W.partitionBy(*key))).where("__run = __last").drop("__run", "__last")


#: Characters of a sequence value that tell its day.
_DAY = 10


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with their day and two 64-bit hashes of all their columns."""
    own = [c for c in rows.columns if c != "__seq"]
    return rows.withColumn("__day", F.coalesce(F.substring("__seq", 1, _DAY), F.lit(""))).withColumn("__a", F.xxhash64(*own)).withColumn("__b", F.xxhash64(F.lit(7), *own))


def _fingerprints(hashed: DataFrame) -> DataFrame:
    """(day, n, x, y): what tells whether the rows of a day have changed."""
    return hashed.groupBy(F.col("__day").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("__a").alias("x"), F.sum(F.shiftrightunsigned("__b", 24)).alias("y"))


def run_incremental(
    log: CommitLog,
    source: DataFrame,
    sequence: Column,
    process: Callable[[DataFrame, DataFrame], DataFrame],
    before_commit: Callable[[], None] | None = None,
    until: str | None = None,
    unfinished: Callable[[], bool] = lambda: False,
) -> Commit | None:
    """Process the rows of ``source`` that no commit took, up to the limit found at the start; None if there are none and nothing is ``unfinished``.

    ``process(new, upto)`` gets the new rows and all rows up to the limit, which is the greatest sequence value, or the greatest up
    to ``until``. ``before_commit`` is a hook for tests of broken runs.
    """
    last = log.last()
    seq = sequence.cast("string") if not isinstance(sequence, str) else F.col(sequence).cast("string")
    rows = source.withColumn("__seq", seq)
    high = rows.agg(F.max(F.when(F.lit(until is None) | (F.col("__seq") <= F.lit(until)), F.col("__seq")))).first()[0]
    low = last.high if last else None
    if low is not None and (high is None or high < low):
        high = low
    upto = rows.where(F.col("__seq").isNull() | (F.col("__seq") <= F.lit(high)))
    hashed = _hashed(upto)
    new = hashed
    if last is not None:
        above = F.lit(low is None) & F.col("__seq").isNotNull() | F.coalesce(F.col("__seq") > F.lit(low), F.lit(False))
        below = hashed.where(~above)
        now, then = _fingerprints(below), log.spark.read.parquet(last.days)
        # a day is one row here; changed days are few
        changed = now.join(then.select("day", F.struct("n", "x", "y").alias("old")), "day", "left").where(~F.struct("n", "x", "y").eqNullSafe(F.col("old"))).select(F.col("day").alias("__day"))
        taken = log.spark.read.parquet(*[c.taken for c in log.commits() if c.taken])
        late = below.join(changed, "__day", "left_semi").join(taken.hint("merge"), ["__day", "__a", "__b"], "left_anti")
        new = hashed.where(above).unionByName(late.select(*hashed.columns))
    root = f"{log.root}/data/{uuid.uuid4().hex}"
    new.select("__day", "__a", "__b").distinct().write.parquet(f"{root}/taken")
    if last is not None and not log.spark.read.parquet(f"{root}/taken").limit(1).count() and not unfinished():
        return None
    _fingerprints(hashed).write.parquet(f"{root}/days")
    extra = ("__seq", "__day", "__a", "__b")
    process(new.drop(*extra), upto.drop("__seq")).write.parquet(f"{root}/output")
    number = last.number + 1 if last else 1
    entry = Commit(number, low, high, f"{root}/output", log.spark.read.parquet(f"{root}/output").count(), f"{root}/taken", f"{root}/days")
    if before_commit:
        before_commit()
    log.commit(entry)
    return entry


def plain_hash(h: Column) -> Column:
    """A hash without what its spelling may differ in: letter case, blanks, a leading ``sha256:``; NULL if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(h)), r"^sha256:\s*", ""), F.lit(""))


def newest_captures(manifests: DataFrame) -> DataFrame:
    """(canonical_source, captured_at, content, config, document_id): the newest capture with both hashes of each source."""
    rows = manifests.select(
        "canonical_source", "captured_at", "document_id", plain_hash(F.col("content_sha256")).alias("content"), plain_hash(F.col("config_sha256")).alias("config"), "ingested_at"
    ).where("canonical_source is not null and content is not null and config is not null")
    newest = rows.groupBy("canonical_source").agg(F.max(F.struct("captured_at", "ingested_at", "document_id", "content", "config")).alias("c"))
    return newest.select("canonical_source", "c.captured_at", "c.content", "c.config", "c.document_id")


def newest_finished(batch_state: DataFrame) -> DataFrame:
    """(canonical_source, done_content, done_config): the newest finished row of each source, by captured_at, then attempts."""
    rows = batch_state.where(F.col("status").isin(*FINISHED) & F.col("source_key").isNotNull())
    newest = rows.groupBy(F.col("source_key").alias("canonical_source")).agg(
        F.max(F.struct("captured_at", "attempts", plain_hash(F.col("content_sha256")).alias("content"), plain_hash(F.col("config_sha256")).alias("config"))).alias("s")
    )
    return newest.select("canonical_source", F.col("s.content").alias("done_content"), F.col("s.config").alias("done_config"), F.lit(True).alias("finished"))


def pending(manifests: DataFrame, batch_state: DataFrame) -> DataFrame:
    """(canonical_source, document_id) of captures that a run must process.

    A source with no finished row, or whose newest capture with both hashes differs from the newest
    finished row in a hash. Sources without any capture that has both hashes are not returned; repeated rows count once.
    """
    joined = newest_captures(manifests).join(newest_finished(batch_state), "canonical_source", "left")
    same = F.col("content").eqNullSafe(F.col("done_content")) & F.col("config").eqNullSafe(F.col("done_config"))
    return joined.where(F.col("finished").isNull() | ~same).select("canonical_source", "document_id")


def captures_to_process(log: CommitLog, manifests: DataFrame, batch_state: DataFrame, before_commit: Callable[[], None] | None = None, until: str | None = None) -> Commit | None:
    """Run the incremental step over manifests: sources with a new row, or left unfinished, up to the limit fixed at the start.

    The output (canonical_source, document_id, waiting) has every source the run looked at; a later run may find that one no longer waits.
    """
    first = log.last() is None
    open_keys = batch_state.where(~F.col("status").isin(*FINISHED) & F.col("source_key").isNotNull()).select(F.col("source_key").alias("canonical_source")).distinct()

    def process(new: DataFrame, upto: DataFrame) -> DataFrame:
        touched = upto if first else new.select("canonical_source").unionByName(open_keys).distinct()
        mine = upto if first else upto.join(touched, "canonical_source", "left_semi")
        waiting = pending(mine, batch_state).withColumn("waiting", F.lit(True))
        seen = mine.select("canonical_source").where("canonical_source is not null").distinct()
        return seen.join(waiting, "canonical_source", "left").select("canonical_source", "document_id", F.coalesce("waiting", F.lit(False)).alias("waiting"))

    sequence = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return run_incremental(log, manifests, sequence, process, before_commit, until, lambda: bool(open_keys.limit(1).count()))


def captures_waiting(log: CommitLog) -> DataFrame | None:
    """(canonical_source, document_id) of captures that wait after all committed runs."""
    now = log.current("canonical_source")
    return None if now is None else now.where("waiting").select("canonical_source", "document_id").distinct()
