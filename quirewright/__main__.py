"""Command line: ``python -m quirewright VERB``. Exit codes: 0 accepted, 2 review, 3 rejected, 4 bad input, 5 failed, 130 interrupted."""

from __future__ import annotations

import argparse
import sys

from quirewright import __version__

ACCEPTED, REVIEW, REJECTED, BAD_INPUT, FAILED, INTERRUPTED = 0, 2, 3, 4, 5, 130


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirewright", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, text in (("convert", "convert HTML files or a table of page blocks"), ("batch", "plan a batch: what is new, changed or unfinished")):
        v = verbs.add_parser(name, help=text)
        v.add_argument("input")
        v.add_argument("--out", required=True)
        v.add_argument("--profile", default="default")
        v.add_argument("--state", help="table of batch states")
        v.add_argument("--force", action="store_true")
        v.add_argument("--max-age", type=int)
    for name, text in (("inspect", "what a job published"), ("status", "documents by status")):
        verbs.add_parser(name, help=text).add_argument("result")
    s = verbs.add_parser("search", help="search published text")
    s.add_argument("result")
    s.add_argument("query")
    e = verbs.add_parser("evaluate", help="evaluate results against a golden set")
    e.add_argument("golden")
    e.add_argument("results")
    e.add_argument("--out", required=True)
    verbs.add_parser("doctor", help="check the environment")
    verbs.add_parser("version", help="print the version")
    return p


def _convert(spark, a) -> int:
    from pyspark.sql import functions as F

    from quirewright import config
    from quirewright.operators import pipeline
    from quirewright.sources import readers

    cfg = config.profile(a.profile)
    blocks = pipeline.convert_pages(spark.read.parquet(a.input)) if a.input.rstrip("/").endswith(".parquet") else pipeline.convert_html(readers.html_pages(spark, a.input, recursive=True).select("source_ref", "html"), cfg)
    done = pipeline.finalize(blocks, cfg, out=a.out)
    counts = {r["status"]: r["n"] for r in done.diagnostics.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    print(", ".join(f"{k} {v}" for k, v in sorted(counts.items())) or "no documents")
    if not counts:
        return BAD_INPUT
    return FAILED if "failed" in counts else REJECTED if "rejected" in counts else REVIEW if "review" in counts else ACCEPTED


def _batch(spark, a) -> int:
    from pyspark.sql import functions as F

    from quirewright import config
    from quirewright.operators import batch
    from quirewright.sources import readers

    items = readers.with_identity(readers.batch_input(spark, a.input, recursive=True)).select(F.col("canonical_source").alias("source_key"), "source", F.lit(None).cast("string").alias("content_sha256"))
    state = spark.read.parquet(a.state) if a.state else spark.createDataFrame([], "source_key string, status string, document_id string, document_dir string, content_sha256 string, config_sha256 string, attempts int, captured_at timestamp")
    plan = batch.resume_plan(items, state, config.profile(a.profile).sha256(), force=a.force, max_age=a.max_age)
    plan.write.mode("overwrite").parquet(f"{a.out}/plan")
    spark.read.parquet(f"{a.out}/plan").groupBy("action", "reason").count().orderBy("action", "reason").show(truncate=False)
    return ACCEPTED


def main(argv: list[str] | None = None) -> int:
    """Run a verb and return its exit code."""
    a = _parser().parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return ACCEPTED
    if a.verb == "doctor":
        import importlib.util

        for m in ("pyspark", "pyarrow", "pandas", "numpy", "tiktoken"):
            print(m, "ok" if importlib.util.find_spec(m) else "missing")
        return ACCEPTED if all(importlib.util.find_spec(m) for m in ("pyspark", "pyarrow", "pandas", "numpy")) else FAILED
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    from quirewright.session import local_session

    spark = local_session()
    try:
        if a.verb == "convert":
            return _convert(spark, a)
        if a.verb == "batch":
            return _batch(spark, a)
        if a.verb == "status":
            spark.read.parquet(f"{a.result}/diagnostics").groupBy("status").count().orderBy("status").show()
        elif a.verb == "inspect":
            spark.read.parquet(f"{a.result}/diagnostics").select("document_id", "status", "overall_quality_score", "blocks", "unresolved_visual_count").orderBy("document_id").show(1000, truncate=False)
        elif a.verb == "search":
            from quirewright.operators.search import search

            md = spark.read.option("wholetext", "true").text(f"{a.result}/markdown").select("document_id", F.col("document_id").alias("title"), F.col("value").alias("full_text"))
            search(md, a.query).show(100, truncate=False)
        elif a.verb == "evaluate":
            from quirewright.operators.pipeline import evaluate_golden
            from quirewright.sources.readers import golden_manifest

            made = evaluate_golden(golden_manifest(spark, a.golden), spark.read.parquet(a.results), [(0.6, 0.85), (0.6, 0.99)], a.out)
            made["aggregates"].show(100, truncate=False)
        return ACCEPTED
    except (AnalysisException, FileNotFoundError, ValueError) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return BAD_INPUT
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
