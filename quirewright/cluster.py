"""What every operator needs from the cluster: a shared folder for cut lineage, joins that
survive hot keys, broadcasts behind a check of their size.

Nothing here keeps state on one machine: intermediate tables are parquet in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read and not a recomputation of
the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most so many rows and takes at most so many bytes in memory, decoded.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Copies of each row of the smaller side in a salted join; a key that holds a third of all rows is read by so many tasks.
SALTS = 16
#: A table of at most so many bytes may be redistributed for parallelism.
SPREAD_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made, which is right only for a single-machine
    master (tests); on any other master the setting is demanded.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="quirewright-")
    return "file://" + _local_dirs[app]


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application.

    Nothing is done where the workers inherit a PYTHONPATH that has it, or where it is installed.
    """
    import os
    import shutil
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or "site-packages" in home.parts or str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quirewright-"), "quirewright"), "zip", home, "quirewright")
    spark.sparkContext.addPyFile(made)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and Catalyst knows the size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; DataFrames made from it can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quirewright/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df``, a plain scan, reads, as Catalyst knows them: one call however many files there are."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _width(df: DataFrame, column: str) -> Column:
    """Bytes of a column's values in a row held in memory: those of strings and binaries counted, arrays by their elements, eight for the rest."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if kind in ("array<string>", "array<binary>"):
        return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 8), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def fits_broadcast(scan: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a materialized table is provably small enough to be broadcast: by its rows and their width in memory.

    The size of its files proves nothing, for numbers that repeat are compressed a hundredfold; it only rules tables out early.
    """
    if scan_bytes(scan) > size:
        return False
    width = sum((_width(scan, c) for c in scan.columns), F.lit(16))
    n, held = scan.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return n <= rows and (held or 0) <= size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    materialized: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to ``right``, the smaller side with few rows per key (one, mostly), whatever the skew of ``left``.

    ``right`` is broadcast if its size in memory allows it. Otherwise every row of ``right`` is
    repeated ``salts`` times and the rows of ``left`` are spread over the repeats by a hash of
    ``spread`` (all other columns of simple type if not given), so a hot key is shared by many tasks. That join is
    told to merge: Catalyst knows the repeated table by the size of its files only and would broadcast it.
    """
    table = right if materialized else materialize(right, "lookup")
    if fits_broadcast(table):
        return left.join(F.broadcast(table), list(on), how)
    cols = spread or [c for c, t in left.dtypes if not t.startswith(("array", "map", "struct"))]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(table.hint("merge"), [*on, "__salt"], how).drop("__salt")


def key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data, ``right`` with about one row per key: shuffled and merged at every size.

    Neither side is written or counted before. A key that many rows of ``left`` share (copies of one record) makes one large
    partition, which adaptive execution splits, as it may for each kind of join that keeps rows of ``left``.
    """
    return left.join(right.hint("merge"), list(on), how)


def hash_sample(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``keys``, the same in every run; all of a smaller table.

    A cut-off on the hash, set from the table's count, leaves about twice as many rows before they are sorted, so
    that tasks send the driver their share of the sample and not a whole sample each.
    """
    n = df.count()
    if n <= rows:
        return df
    h = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 62) - 1))
    share = min(1.0, (2 * rows + 100) / n)
    return df.where(h < F.lit(int(share * ((1 << 62) - 1)))).orderBy(h, *keys).limit(rows)


def dense_rank_in_groups(df: DataFrame, key: str, order: Sequence[str], rank: str, rows_each: int = 50_000) -> DataFrame:
    """Number the rows of each ``key`` from 0 without ever sorting one whole group in one task.

    Rows are dealt into buckets by a hash of ``order`` (which must identify a row), numbered
    within (key, bucket), and shifted by the counts of the buckets before; the table of counts has
    at most keys x buckets rows. ``df`` should be materialized, for it is read twice.
    """
    from pyspark.sql import Window as W

    buckets = max(1, -(-df.count() // rows_each))
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = dealt.withColumn("__i", F.row_number().over(W.partitionBy(key, "__b").orderBy(*order)) - 1)
    return (
        numbered.join(starts.hint("merge"), [key, "__b"])
        .withColumn(rank, F.col("__start") + F.col("__i"))
        .drop("__b", "__i", "__start", "__n")
    )


def spread_small(df: DataFrame) -> DataFrame:
    """Give CPU-heavy stages a task for each core where a small table lies in fewer files than there are cores.

    Only a plain scan of at most ``SPREAD_BYTES`` is spread; a larger one has splits enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if 0 < len(files) < cores and scan_bytes(df) <= SPREAD_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a test-data folder, spread over the cores if asked for and small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if spread else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed once, however often it is used: a generator of one row keeps Catalyst from copying it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def first_set(*cols: Column) -> Column:
    """The first of the columns that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction of the conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
