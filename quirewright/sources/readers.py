"""Sources: HTML folders, URL lists, JSONL manifests, directories, images; page blocks of a PDF through a pluggable reader."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.functions.text import canonical_source, source_type

MANIFEST = "source string, id string, tags array<string>, profile string"


def html_pages(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(source_ref, html) of the HTML files under a path, one row each; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("source_ref"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"), F.sha2("content", 256).alias("content_sha256"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(source) of a list with one URL a line; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("source"))
    return lines.where((F.col("source") != "") & ~F.col("source").startswith("#"))


def jsonl_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, tags, profile, extra) of a JSONL manifest. A line that isn't JSON, or has no ``source``, fails the query; other keys go to ``extra``."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    parsed = lines.select(F.from_json("v", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"), F.from_json("v", "map<string,string>").alias("all"), "v")
    bad = F.raise_error(F.concat(F.lit("manifest line without a source: "), F.col("v"))).cast("string")
    rest = F.map_filter("all", lambda k, x: ~k.isin("source", "id", "tags", "profile"))
    return parsed.select(F.when(F.col("m.source").isNull(), bad).otherwise(F.col("m.source")).alias("source"), "m.id", F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"), "m.profile", F.to_json(rest).alias("extra"))


def directory(spark: SparkSession, path: str, recursive: bool = False, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(source, length, modified) of PDF and HTML files, by patterns on the file name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified"))
    name = F.substring_index("source", "/", -1)
    out = files.where(F.lower(name).rlike(r"\.(pdf|html?)$"))
    if include:
        out = out.where(name.rlike(_glob(include)))
    return out.where(~name.rlike(_glob(exclude))) if exclude else out


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\z", r"\Z").replace("(?s:", "^(?s:")


def batch_input(spark: SparkSession, path: str, **options) -> DataFrame:
    """Sources of a batch, by what the path holds: a manifest, a list, or a folder."""
    low = path.lower()
    if low.endswith((".jsonl", ".json")):
        return jsonl_manifest(spark, path).select("source")
    if low.endswith((".txt", ".urls", ".list")):
        return url_list(spark, path)
    from pyspark.errors import AnalysisException

    try:
        first = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").limit(1).collect() if not _is_folder(spark, path) else []
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if first:
        return jsonl_manifest(spark, path).select("source") if first[0][0].strip().startswith("{") else url_list(spark, path)
    return directory(spark, path, **options).select("source")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def with_identity(sources: DataFrame) -> DataFrame:
    """Sources with their type and canonical form; what can't be told is an error row of its own in ``error``."""
    kind = source_type(F.col("source"))
    return sources.withColumn("source_type", kind).withColumn("canonical_source", canonical_source(F.col("source"))).withColumn("error", F.when(kind.isNull(), F.concat(F.lit("unknown source type: "), F.col("source"))))


def golden_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Golden samples of a JSONL file; comments are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    schema = "sample_id string, source_document string, source_type string, visual_type string, language string, image_path string, gold_verbatim string, line_numbers_present boolean, critical_tokens array<string>, notes string"
    return lines.select(F.from_json("value", schema).alias("g")).select("g.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, content_sha256, format) of image files."""
    from quirewright.functions.text import image_format

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("content_sha256"), image_format(F.col("content")).alias("format"))
