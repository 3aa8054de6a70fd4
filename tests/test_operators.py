"""Document-level operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quirewright.operators import batch, enrich, evaluate, html, pages, quality, reconstruct, render, review, search


# ---- reconstruction ---------------------------------------------------------------------------------------------


def removed(blocks):
    return {r.block_id for r in reconstruct.removed_furniture(blocks).collect()}


def test_header_on_five_pages(blocks_of):
    b = blocks_of([{"text": "Great Book", "page": p, "y0": 30, "order": 2 * p} for p in range(1, 6)] + [{"text": f"Body {p} is here.", "page": p, "y0": 300, "order": 2 * p + 1, "block_id": f"x{p}"} for p in range(1, 6)])
    assert len(removed(b)) == 5


def test_alternating_headers_and_page_numbers(blocks_of):
    rows = [{"text": f"Sorting mail by hand    {p}" if p % 2 else f"{p}    The depot handbook", "page": p, "y0": 40} for p in range(1, 9)]
    assert len(removed(blocks_of(rows))) == 8
    assert len(removed(blocks_of([{"text": str(p), "page": p, "y0": 770} for p in range(1, 5)]))) == 4


def test_what_stays(blocks_of):
    code = [{"type": "native_code", "text": "import os", "page": p, "y0": 30} for p in range(1, 6)]
    toc = [{"text": f"Section one {p}", "page": p, "y0": 260, "y1": 280} for p in range(1, 6)]
    assert removed(blocks_of(code)) == set()
    assert removed(blocks_of(toc)) == set()
    assert removed(blocks_of([{"text": "Great Book", "page": p, "y0": 30} for p in (1, 2)])) == set()


def test_generator_footer(blocks_of):
    stamp = [{"type": "visual", "raw": "POWERED BY  tcpdf", "page": p, "y0": 350 + p, "block_id": f"s{p}"} for p in (2, 5, 6, 9)]
    assert removed(blocks_of(stamp + [{"text": "The depot opens at six.", "page": 2, "y0": 300}])) == {"s2", "s5", "s6", "s9"}


def merged(blocks):
    return reconstruct.merge_pages(blocks).orderBy("block_order").collect()


def test_merges(blocks_of):
    r = merged(blocks_of([{"text": "They kept send-", "page": 1, "y0": 700}, {"text": "ing when asked.", "page": 2, "y0": 90}]))
    assert [x.text for x in r] == ["They kept sending when asked."]
    assert r[0].transformations == ["merged_cross_page_paragraph", "dehyphenated_cross_page_prose"]
    assert len(merged(blocks_of([{"text": "Then call rsync --delete-", "page": 4, "y0": 710}, {"text": "after /srv/depot", "page": 5, "y0": 95}]))) == 2
    code = merged(blocks_of([{"type": "native_code", "text": "if user:", "page": 1, "y0": 700, "language": "python"}, {"type": "native_code", "text": "    print(user)", "page": 2, "y0": 90, "language": "python"}]))
    assert [x.text for x in code] == ["if user:\n    print(user)"]
    numbers = merged(blocks_of([{"type": "native_code", "text": "11 a = 1", "page": 1, "y0": 1}, {"type": "native_code", "text": "12 b = 2", "page": 2, "y0": 1}]))
    assert len(numbers) == 1
    unsafe = merged(blocks_of([{"text": "It goes on and", "page": 1, "y0": 1}, {"type": "quote", "text": "on like this", "page": 2, "y0": 1}]))
    assert [x.unsafe_next for x in unsafe] == [["b_000001"], []]


def test_furniture_goes_before_pages_are_merged(blocks_of):
    """A sentence over two page ends, with a footer and a header standing between its parts."""
    parts = {3: "The sorter waits until the", 4: "belt has stopped and", 5: "starts again."}
    rows = [{"text": t, "page": p, "y0": 420, "order": 100 * p + 50, "block_id": f"part{p}"} for p, t in parts.items()]
    rows += [{"text": f"- {p} -", "page": p, "y0": 785, "order": 100 * p + 90, "block_id": f"foot{p}"} for p in parts]
    rows += [{"text": "The depot handbook", "page": p, "y0": 28, "order": 100 * p, "block_id": f"head{p}"} for p in parts]
    assert {x for x in removed(blocks_of(rows)) if x.startswith("foot")} == {"foot3", "foot4", "foot5"}
    texts = [r.text for r in reconstruct.reconstruct(blocks_of(rows)).orderBy("block_order").collect()]
    assert texts[0].startswith("The sorter waits until the belt has stopped")


def test_full_completeness(spark):
    row = "document_id string, page_number int, state string, native_text_chars int, visual_count int, visuals_represented int, fallbacks int, suspicious boolean, seconds double"
    pages_ = spark.createDataFrame([("d", 1, "verified", 10, 1, 1, 0, False, 301.0), ("d", 2, "verified", 10, 0, 0, 0, None, None), ("e", 2, "verified", None, 2, 1, 0, True, 1.0), ("f", 1, "missing", 0, 0, 0, 0, False, 0.0)], row)
    md = spark.createDataFrame([("d", "text"), ("e", "![x](y) <IMG src='data:image/png'>\n  ```\nopen")], "document_id string, markdown string")
    r = {x.document_id: x for x in batch.full_completeness(pages_, md).collect()}
    assert r["d"].hard_pass and (r["d"].pages_suspicious, r["d"].native_text_coverage_ratio) == (1, 0.2)
    e = r["e"]
    assert (e.pages_total, e.pages_visited, e.page_sequence_gaps, e.visuals_missing, e.markdown_image_count, e.html_img_count, e.base64_image_count, e.unclosed_fence_count, e.hard_pass) == (2, 2, 1, 1, 1, 1, 1, 1, False)
    assert r["f"].page_sequence_gaps == 1 and not r["f"].hard_pass
    more = batch.full_completeness(pages_, expected=spark.createDataFrame([("d", 4)], "document_id string, pages_total int")).where("document_id = 'd'").first()
    assert (more.pages_total, more.page_sequence_gaps, more.hard_pass) == (4, 2, False)
    assert len(more) == 2 + 22


def test_order_and_partitions_do_not_matter(spark, blocks_of):
    rows = [{"document_id": f"d{i % 7}", "text": f"part {i} goes" if i % 3 else "and on.", "page": i // 7 + 1, "y0": 300, "block_id": f"b{i:03d}", "order": i} for i in range(70)]
    b = blocks_of(rows)
    a = sorted(map(tuple, reconstruct.merge_pages(b).select("document_id", "block_order", "text").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        c = sorted(map(tuple, reconstruct.merge_pages(b.orderBy(F.rand(1)).repartition(9)).select("document_id", "block_order", "text").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == c


# ---- quality and rendering --------------------------------------------------------------------------------------


def test_quality(blocks_of):
    b = blocks_of([{"type": "heading", "text": "T"}, {"text": "p"}, {"type": "visual", "visual_type": "code", "visual_state": "review_required", "confidence": 0.5, "review": True}])
    r = quality.quality_report(b).first()
    assert (r.unresolved_visual_count, r.low_confidence_blocks, r.confidence_none) == (1, 1, 1)
    assert r.native_text_coverage == pytest.approx(2 / 3)
    assert r.overall_quality_score == pytest.approx(0.5 * 2 / 3 + 0.1)
    text_only = quality.quality_report(blocks_of([{"type": "heading", "text": "T"}, {"text": "p"}])).first()
    assert text_only.overall_quality_score == pytest.approx(0.6)


def test_coverage(blocks_of):
    b = blocks_of([{"type": "visual", "visual_state": "resolved_ocr"}, {"type": "visual", "visual_state": "review_required"}, {"type": "visual", "coverage_state": "native_text_used"}])
    r = quality.coverage_summary(b).first()
    assert (r.total_visual_blocks, r.transcribed, r.native_text_used, r.missing, r.all_covered) == (3, 1, 1, 1, False)
    assert quality.uncovered_visuals(b).count() == 1


def test_completeness(spark, blocks_of):
    md = spark.createDataFrame([("d1", "![a](b)\n```x\n<!-- quirewright: [UNRESOLVED] -->")], "document_id string, markdown string")
    r = quality.completeness(md, blocks_of([{"text": "x"}])).first()
    assert r.failed_invariants == ["image_syntax_count", "unclosed_fence_count", "html_comment_marker_count"]
    assert quality.completeness(md, blocks_of([{"text": "x"}]), "strict").first().failed == 2


def test_page_flags(spark):
    texts = ["\n".join("abcdefghijklmnopqrst"), "\n".join(["HEADER"] * 25 + ["body"] * 2), "The provided image shows nothing", "0" * 100, "Some Title 12", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    r = {x.k: x for x in quality.page_flags(df, "k").collect()}
    assert r[0].one_char_per_line and r[1].extremely_duplicated and r[2].chatty and r[3].repeated_chars and r[4].only_furniture
    assert not any((r[5].one_char_per_line, r[5].extremely_duplicated, r[5].chatty, r[5].repeated_chars, r[5].only_furniture))


def test_render(blocks_of):
    b = blocks_of([
        {"type": "heading", "text": " T ", "heading_level": 1}, {"type": "list", "list_items": ["a", "b"]}, {"type": "quote", "text": "x\ny"}, {"type": "visual", "visual_state": "ignored_decorative"},
        {"type": "native_code", "text": "a\n", "language": "py"}, {"type": "visual", "visual_type": "code", "visual_state": "review_required", "raw": "z", "selected": ""},
    ])
    md = render.render_documents(b).first().markdown
    assert md == (
        "# T\n\n\n\n- a\n- b\n\n\n\n> x\n> y\n\n\n\n```py\na\n```\n\n\n\n> The source contains a code visual at this position whose transcription is uncertain. A partial transcription follows:\n```\nz\n```\n"
    )
    strict = render.render_documents(b, "strict").first().markdown
    assert strict.endswith("<!-- quirewright: [REVIEW REQUIRED] visual=code block=b_000005 -->\n")


def test_table(spark):
    df = spark.createDataFrame([([["a", "b"], ["1"], ["2", "3", "4"]],), ([],)], "rows array<array<string>>")
    assert [r[0] for r in df.select(render.table_markdown(F.col("rows"))).collect()] == ["| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", ""]


# ---- pages ------------------------------------------------------------------------------------------------------

PB = "pb_id long, document_id string, page int, bbox array<double>, text string, is_code_like boolean, language string, from_ocr_layer boolean, page_width double, page_height double"


def pb(spark, rows):
    return spark.createDataFrame([(i, "d", r.get("page", 1), r.get("bbox"), r.get("text"), False, None, r.get("ocr"), 600.0, 800.0) for i, r in enumerate(rows)], PB)


def test_ocr_dedup(spark):
    t = "The same sentence stands here twice."
    rows = [{"text": t}, {"text": t.upper() + "  ", "ocr": True}, {"text": "short text", "ocr": True}, {"text": t, "ocr": True, "page": 2}, {"text": None, "ocr": True}]
    assert [r.pb_id for r in pages.duplicate_ocr_blocks(pb(spark, rows)).collect()] == [1]


def test_columns(spark):
    two = [{"bbox": [x, y, x + 200.0, y + 50.0]} for x in (20.0, 380.0) for y in (100.0, 200.0)]
    assert pages.page_columns(pb(spark, two)).first().columns == 2
    assert pages.page_columns(pb(spark, [{"bbox": [20.0, 1.0, 580.0, 9.0]}] * 5)).first().columns == 1


def test_scanned_and_image_class(spark):
    r = pages.scanned_pages(pb(spark, [{"text": "x"}])).first()
    assert r.scanned and r.chars == 1
    df = spark.createDataFrame([("", 0), ("Figure 3 shows", 0), ("word " * 60, 0)], "t string, px long")
    c = pages.image_class(F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(55.0)), F.col("px"), F.lit(10_000.0), F.col("t"), F.lit(False))
    assert [x[0] for x in df.select(c).collect()] == ["ignored_decorative", "ocr_candidate", "described_as_text"]


# ---- HTML -------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>Page</title></head><body><nav><a>n</a></nav><article><h1>Head</h1><p>One <b>two</b><p>three
<div class="box"><button data-copy="real code">Copy</button><pre><code class="language-python">shown</code></pre></div>
<img src="s.png" alt="Screenshot of the code above"><ul><li>a<li>b</ul><img src="data:," data-src="/late.png" alt="a fox">
<img src="i.png" class="icon big"><blockquote>q</blockquote><table><tr><th>h<td>d</table><hr><script>x</script><div class="ad-slot">ad</div></article></body></html>"""


def test_html(spark):
    df = html.html_blocks(spark.createDataFrame([("u", PAGE), ("v", None), ("w", "")], "source_ref string, html string"))
    r = df.orderBy("block_order").collect()
    assert {x.source_ref for x in r} == {"u"}
    assert [x.type for x in r] == ["heading", "paragraph", "paragraph", "native_code", "list", "visual", "visual", "quote", "table", "horizontal_rule"]
    assert r[1].text == "One\ntwo" and r[2].text == "three"
    assert (r[3].text, r[3].text_source, r[3].language) == ("real code", "copy_button", "python")
    assert r[4].list_items == ["a", "b"] and r[8].table_rows == [["h", "d"]]
    assert r[5].best_url == "/late.png" and r[5].visual_state == "review_required"
    assert r[6].visual_state == "ignored_decorative" and r[6].coverage_reason == "class hint 'icon'"


def test_absolute_url(spark):
    df = spark.createDataFrame([("//a/b",), ("/c",), ("d.png",), ("https://x/y",), ("data:image/png;base64,A",)], "u string")
    assert [r[0] for r in df.select(html.absolute_url(F.col("u"), F.lit("https://h.org/p/"))).collect()] == ["https://a/b", "https://h.org/c", "https://h.org/p/d.png", "https://x/y", None]


# ---- enrichment and evaluation ----------------------------------------------------------------------------------


def test_context(blocks_of):
    b = blocks_of([{"text": "far"}, {"text": "x" * 400}, {"text": "near"}, {"type": "visual"}, {"text": "after"}, {"type": "visual"}])
    r = {x.block_id: x for x in enrich.with_context(b).collect()}
    assert r["b_000003"].preceding == "near\n" + "x" * 400 and r["b_000003"].following == "after"
    assert r["b_000005"].preceding == "after" and r["b_000005"].following == ""


def test_enrich(spark, blocks_of):
    b = blocks_of([{"type": "visual", "block_id": k} for k in ("num", "none", "empty", "term")] + [{"type": "visual", "block_id": "done", "visual_state": "resolved_ocr"}])
    results = spark.createDataFrame([("d1", "num", "1 import os\n2 print(1)", 0.995), ("d1", "empty", " ", 0.9), ("d1", "term", "$ python exploit.py\nok", 0.5)], "document_id string, block_id string, text string, confidence double")
    r = {x.block_id: x for x in enrich.enrich(b, results).collect()}
    assert set(r) == {"num", "none", "empty", "term"}
    assert r["num"].visual_state == "resolved_ocr" and r["num"].selected_text == "import os\nprint(1)"
    assert r["none"].visual_state == "failed" and r["empty"].visual_state == "review_required"
    assert r["term"].visual_type == "terminal" and [s.role for s in r["term"].segments] == ["command", "output"]
    assert r["term"].confidence == pytest.approx(0.52)


def test_recognizers(spark):
    import pandas as pd

    class Upper:
        name, version = "upper", "1"

        def recognize(self, images):
            for s in images:
                yield pd.DataFrame({"text": [bytes(x).decode().upper() for x in s], "confidence": 0.9, "regions": [[] for _ in s]})

    enrich.register("external", Upper)
    df = spark.createDataFrame([(1, bytearray(b"abc"))], "i int, content binary")
    assert enrich.recognize(df, enrich.recognizer("auto")).first().text == "ABC"
    with pytest.raises(LookupError):
        enrich.recognizer("no-such")
    known = spark.createDataFrame([("h", "t", 0.4), ("h", "u", 0.6)], "content_sha256 string, text string, confidence double")
    got = enrich.recognize_by_table(spark.createDataFrame([("h",), ("k",)], "content_sha256 string"), known).orderBy("content_sha256").collect()
    assert [(r.text, r.confidence) for r in got] == [("u", 0.6), ("", 0.0)]


def test_code_repairs(spark, blocks_of, tmp_path):
    from quirewright.plans import core_queries

    raw = {
        "all": ("code", "importos\r\nif x：\ny = 1"), "numbers": (None, "1 a\n2 b"), "wide": ("http", "GET /apiv1（x）"), "term": ("terminal", "$ lsx\nout"), "prose": ("code", "你好，世界。"), "plain": ("code", "plain"), "blank": ("diff", ""),
    }
    rows = [{"type": "visual", "block_id": k, "visual_type": v, "raw": t} for k, (v, t) in raw.items()]
    blocks_of([*rows, *rows, {"type": "visual", "block_id": "none"}, {"block_id": "text", "raw": "importos"}]).write.parquet(str(tmp_path / "blocks.parquet"))
    df = core_queries.QUERIES["code_repairs"](spark, str(tmp_path))
    assert {r.block_id: (r.selected_text, r.steps) for r in df.collect()} == {
        "all": ("import os\nif x:\n    y = 1", ["post_processed", "split:importos->import os", "fullwidth_punct_normalized:1chars", "indent_recovered"]),
        "numbers": ("a\nb", ["post_processed"]), "wide": ("GET /apiv1(x)", ["fullwidth_punct_normalized:2chars", "panel_split"]), "term": ("$ lsx\nout", ["panel_split"]), "prose": ("你好，世界。", []), "plain": ("plain", []), "blank": ("", []),
    }
    assert df.count() == len(raw)

    def widest(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        return max([node.output().size(), *map(widest, below)])

    # rows that wait for Python hold each stage once; copies of an expression over the distinct rows would be columns of their own
    assert widest(df._jdf.queryExecution().sparkPlan()) <= 16


def test_best_candidate(spark):
    df = spark.createDataFrame([("k", 0, "importosx", 0.9, "code"), ("k", 1, "import os\nfor x in y:\n    print(x)", 0.5, "code"), ("t", 0, "same", 0.5, None), ("t", 1, "same", 0.5, None)], "k string, view int, text string, confidence double, visual_type string")
    assert {r.k: r.view for r in enrich.best_candidates(df, ["k"]).collect()} == {"k": 1, "t": 0}


def test_calibration(spark):
    rows = [("a", 0.0, 0.9, True, 1.0), ("b", 0.2, 0.9, False, 1.0), ("c", 0.0, 0.7, False, 1.0), ("d", 0.5, 0.1, True, 0.0)]
    m = spark.createDataFrame(rows, "sample_id string, cer double, confidence double, has_critical boolean, critical_token_recall double")
    r = evaluate.calibrate(m, [(0.6, 0.85), (0.6, 0.99)]).orderBy("high").collect()
    assert (r[0].accepted_count, r[0].false_accept_count, r[0].review_count, r[0].false_review_count, r[0].rejected_count) == (2, 1, 1, 1, 1)
    assert r[1].accepted_count == 0 and r[1].accepted_precision == 1.0 and r[1].accepted_mean_cer is None


# ---- search, review, batches ------------------------------------------------------------------------------------


def test_search(spark):
    c = spark.createDataFrame([("b", "B", "cat cat dog"), ("a", "A", "cat cat"), ("c", "C", "bird dog-cat")], "document_id string, title string, full_text string")
    assert [(r.document_id, r.score) for r in search.search(c, "cat").collect()] == [("a", 2.0), ("b", 2.0)]
    assert [(r.document_id, r.score) for r in search.search(c, "cat dog", index=search.postings(c)).collect()] == [("b", 3.0), ("a", 2.0)]
    assert [r.document_id for r in search.search(c, '"cat dog"').collect()] == ["b"]
    assert search.search(c, "  ").count() == 0 and search.search(c, "cat", limit=1).count() == 1


def test_postings_of_all_documents_and_tokens(spark, tmp_path):
    from quirewright.plans import core_queries

    rows = [(1, "Cat cat-dog 日本", "en"), (2, "日本語 日本語 テスト、猫 a", None), (3, "été — x", "it"), (4, None, "en"), (5, " \u3000", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.token): r.tf for r in core_queries.QUERIES["postings_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, "cat"): 1, (1, "cat-dog"): 1, (1, "日本"): 1, (2, "日本語"): 2, (2, "テスト、猫"): 1, (2, "a"): 1, (3, "t"): 1, (3, "—"): 1, (3, "x"): 1}


def test_review(spark, blocks_of):
    from datetime import datetime as D

    edits = spark.createDataFrame(
        [("d1", "b_000000", "correction", "x", "u", D(2024, 1, 1)), ("d1", "b_000000", "correction", "x", "u", D(2024, 1, 2)), ("d1", "b_000000", "correction", "y", "u", D(2024, 1, 3)), ("d1", review.DOCUMENT, "status", "accepted", "u", D(2024, 1, 1))],
        "document_id string, block_id string, field string, value string, user string, timestamp timestamp",
    )
    log = review.effective_revisions(edits)
    assert log.count() == 3
    s = review.review_state(log).first()
    assert s.status == "accepted" and s.corrections == {"b_000000": "y"} and s.notes is None
    assert review.with_corrections(blocks_of([{"text": "t"}]), log).first().shown_text == "y"
    assert review.export_reviews(log).groupBy("kind").count().count() == 2


def test_resume_plan(spark):
    from datetime import datetime as D

    state = [("a", "accepted", "d", "dir", "h1", "c", 1, D(2024, 1, 1)), ("b", "failed", None, None, None, None, 1, D(2024, 1, 1)), ("c", "review", "d", "dir", "h9", "c", 1, D(2024, 1, 1)), ("d", "accepted", "d", "dir", "H1", "old", 1, D(2024, 1, 1))]
    st = spark.createDataFrame(state, "source_key string, status string, document_id string, document_dir string, content_sha256 string, config_sha256 string, attempts int, captured_at timestamp")
    items = spark.createDataFrame([(k, f"/x/{k}.pdf", "sha256:H1") for k in "abcde"], "source_key string, source string, content_sha256 string")
    got = {r.source_key: r.reason for r in batch.resume_plan(items, st, "c").collect()}
    assert got == {"a": "cached", "b": "unfinished", "c": "stale", "d": "configuration changed", "e": "new"}
    assert {r.action for r in batch.resume_plan(items, st, "c", force=True).collect()} == {"process"}
