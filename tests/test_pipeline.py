"""Whole jobs, configuration and command line."""

import pytest
from pyspark.sql import functions as F

from quirewright import config
from quirewright.__main__ import main
from quirewright.functions import text as T
from quirewright.operators import pipeline

PAGE = "<html><body><article><h1>Head</h1><p>Some text that is long enough to stand as a paragraph of its own in this small page.</p><pre>import os</pre></article></body></html>"


def test_config():
    a, b = config.profile(), config.profile("strict")
    assert a.sha256() == config.from_dict({}).sha256() != b.sha256() and b.quality.mode == "strict"
    assert not config.profile("fast").keep_evidence
    assert config.from_dict({"profile": "strict", "recognition": {"backend": "table"}}).recognition.backend == "table"
    for bad in ({"profile": "none"}, {"x": 1}, {"retries": -1}, {"quality": {"mode": "y"}}):
        with pytest.raises((ValueError, TypeError)):
            config.from_dict(bad)


def test_load(tmp_path):
    (tmp_path / "c.json").write_text('{"quality": {"unresolved_policy": "reject"}}')
    assert config.load(str(tmp_path / "c.json")).quality.unresolved_policy == "reject"


def test_html_job(spark, tmp_path):
    cfg = config.profile()
    pages = spark.createDataFrame([("https://e/1", PAGE), ("https://e/2", PAGE.replace("<pre>", '<img src="x.png" alt="a fox"><pre>'))], "source_ref string, html string")
    blocks = pipeline.convert_html(pages, cfg)
    done = pipeline.finalize(blocks, cfg, out=str(tmp_path / "out"))
    status = {r.blocks: r.status for r in done.diagnostics.collect()}
    assert status == {3: "accepted", 4: "review"}
    assert spark.read.parquet(str(tmp_path / "out" / "blocks")).count() == 7
    md = [r[0] for r in done.markdown.select("markdown").collect()]
    assert all(m.startswith("# Head\n") and "```python\nimport os\n```" in m for m in md)
    again = pipeline.finalize(pipeline.convert_html(pages, cfg), cfg).markdown
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.markdown.collect()))
    assert done.provenance.count() == 7 and done.completeness.where("failed > 0").count() == 0
    errors = done.diagnostics.where("blocks = 3").select("document_id", F.lit(1).alias("n"))
    assert {r.status for r in pipeline.finalize(blocks, cfg, errors).diagnostics.collect()} == {"rejected", "review"}
    reject = config.from_dict({"quality": {"unresolved_policy": "reject"}})
    assert "rejected" in {r.status for r in pipeline.finalize(blocks, reject).diagnostics.collect()}


def test_page_job(spark):
    schema = "pb_id long, document_id string, page int, bbox array<double>, text string, is_code_like boolean, language string, from_ocr_layer boolean, page_width double, page_height double"
    rows = [(1, "d", 1, [0.0, 50.0, 9.0, 60.0], "A title", False, None, False, 600.0, 800.0), (2, "d", 1, [0.0, 90.0, 9.0, 99.0], "They kept\nsend-", False, None, False, 600.0, 800.0), (3, "d", 2, [0.0, 50.0, 9.0, 60.0], "ing it all day.", False, None, None, 600.0, 800.0)]
    b = pipeline.convert_pages(spark.createDataFrame(rows, schema))
    assert [(r.block_order, r.type) for r in b.orderBy("block_order").collect()] == [(0, "heading"), (1, "paragraph"), (10000, "paragraph")]
    merged, gone = pipeline.with_reconstruction(b)
    assert gone.count() == 0 and [r.text for r in merged.orderBy("block_order").collect()] == ["A title", "They kept\nsending it all day."]


def test_shards(spark, blocks_of):
    b = blocks_of([{"text": "x", "page": p, "y0": 1} for p in (1, 2)]).withColumn("evidence", F.transform("evidence", lambda e: e.withField("asset_path", F.lit("a.png"))))
    out = pipeline.compile_shards(b, spark.createDataFrame([("d1", 2)], "document_id string, page_number int")).collect()
    assert len(out) == 1 and out[0].evidence[0].asset_path == "pages/0002/a.png"


def test_golden_job(spark, tmp_path):
    g = spark.createDataFrame([("a", "terminal", "bash", ["ls"], False, "$ ls\nout"), ("b", "code", None, [], True, "1 x\n2 y"), ("c", "log", "log", None, False, "z")], "sample_id string, visual_type string, language string, critical_tokens array<string>, line_numbers_present boolean, gold_verbatim string")
    r = spark.createDataFrame([("a", "$ ls\nout", 0.9), ("b", "1 x\n2 z", 0.7)], "sample_id string, actual string, confidence double")
    made = pipeline.evaluate_golden(g, r, [(0.6, 0.85)], str(tmp_path / "e"))
    assert [x.sample_id for x in made["errors"].collect()] == ["c"]
    a = {x.visual_type: x for x in made["aggregates"].collect()}
    assert a["all"].sample_count == 2 and a["terminal"].segmentation_f1_mean == 1.0 and a["code"].segmentation_f1_mean is None
    assert a["code"].cer_mean == pytest.approx(1 / 7)
    assert spark.read.text(str(tmp_path / "e" / "report")).count() == 5


def test_inspect(spark, blocks_of):
    b = blocks_of([{"text": "x ![a](b)", "source_kind": "html"}])
    m = spark.sql("select 'd1' document_id, 'https://e/Post' source, 'url' source_type, 'https://e/post' canonical_source, 'abcdef012345' content_sha256, timestamp '2024-01-01' captured_at")
    done = pipeline.finalize(b, config.profile())
    r = pipeline.inspect(done.diagnostics, m, done.markdown).first()
    assert (r.folder, r.status, r.markdown_images, r.blocks) == ("e-post-abcdef01", "rejected", 0, 1)


def test_chat_answer(spark):
    df = spark.createDataFrame([("User: OCR:\nAssistant: text ",), (" bare ",), ("<|assistant|>x",)], "t string")
    assert [r[0] for r in df.select(T.chat_answer(F.col("t"))).collect()] == ["text", "bare", "x"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE)
    out = str(tmp_path / "out")
    assert main(["version"]) == 0 and main(["doctor"]) == 0
    assert main(["convert", str(tmp_path / "in"), "--out", out]) == 0
    assert main(["status", out]) == 0 and main(["inspect", out]) == 0 and main(["search", out, "paragraph"]) == 0
    assert "accepted" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "nowhere")]) == 4
    (tmp_path / "urls.txt").write_text("https://a/b\n")
    assert main(["batch", str(tmp_path / "urls.txt"), "--out", out]) == 0
