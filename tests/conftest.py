import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quirewright.session import local_session

    s = local_session(4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


BLOCK_SCHEMA = """document_id string, block_order int, block_id string, type string, text string, language string, heading_level int, list_items array<string>, page int, visual_type string, visual_state string,
enrichment struct<visual_type:string,raw_text:string,selected_text:string,language:string,segments:array<struct<role:string,text:string,command:string>>,confidence:double,review_required:boolean,transformations:array<string>,backend:string,backend_version:string>,
evidence array<struct<kind:string,page:int,bbox:array<double>,url:string,selector:string,asset_path:string,content_sha256:string>>, provenance_source_ref string, site string, source_kind string, coverage_state string, coverage_reason string, extra string"""


@pytest.fixture(scope="session")
def blocks_of(spark):
    """Make a blocks table from dicts; ``y0`` and ``page`` give the evidence, ``selector`` too; ``raw``, ``selected``, ``confidence`` the enrichment."""

    def make(rows, extra_columns=None):
        out = []
        for i, r in enumerate(rows):
            e = None
            if any(k in r for k in ("raw", "selected", "confidence")):
                e = (r.get("visual_type"), r.get("raw"), r.get("selected"), r.get("elang"), [], r.get("confidence", 0.9), r.get("review", False), r.get("steps", []), r.get("backend"), None)
            y0 = r.get("y0")
            ev = [("pdf_region" if y0 is not None else "dom_element", r.get("page"), [10.0, float(y0), 200.0, float(r.get("y1", y0 + 20))] if y0 is not None else None, None, r.get("selector"), None, None)]
            out.append((
                r.get("document_id", "d1"), r.get("order", i), r.get("block_id", f"b_{i:06d}"), r.get("type", "paragraph"), r.get("text"), r.get("language"), r.get("heading_level"), r.get("list_items"), r.get("page"), r.get("visual_type"),
                r.get("visual_state"), e, ev, r.get("ref"), None, r.get("source_kind", "pdf"), r.get("coverage_state"), None, r.get("extra"),
            ))
        df = spark.createDataFrame(out, BLOCK_SCHEMA)
        for name, value in (extra_columns or {}).items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make
