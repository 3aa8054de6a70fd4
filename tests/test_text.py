"""Scalar functions against hand-made cases and plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirewright.functions import code as C
from quirewright.functions import metrics as M
from quirewright.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def many(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_identity(spark):
    urls = ["HTTPS://Ex.ORG/A/b/?q=1#f", "https://ex.org/", "https://ex.org/a//", "/shelf/A.pdf", "file:///x/Y.html"]
    assert many(spark, T.canonical_source, urls) == ["https://ex.org/A/b?q=1", "https://ex.org", "https://ex.org/a/", "/shelf/A.pdf", "file:///x/Y.html"]
    assert many(spark, T.source_type, [*urls, "x.txt"]) == ["url", "url", "url", "pdf", "url", None]
    want = hashlib.sha256(b"c\x1fs\x1fg").hexdigest()[:16]
    assert one(spark, T.document_id(F.col("a"), F.col("b"), F.col("c")), a="c", b="s", c="g") == want


def test_slug(spark):
    f = lambda kind: (lambda c: T.slug(c, F.lit(kind)))
    assert many(spark, f("url"), ["https://www.ex.org/p/My%20Post.html", "https://ex.org/"]) == ["ex-org-my-20post", "ex-org"]
    assert many(spark, f("pdf"), ["/a/Große Übung.PDF", "/a/" + "x-" * 60, "/a/---.pdf"])[1] == ("x-" * 20).rstrip("-")
    assert many(spark, f("pdf"), ["/a/---.pdf"]) == ["doc"]


def test_lines_and_strip(spark):
    texts = ["a\nb\n", "", "a\r\nb\rc", "\n", "x\u2028y\x0bz"]
    assert many(spark, T.split_lines, texts) == [t.splitlines() for t in texts]
    assert many(spark, T.strip, ["\u2003 a\t\n", "\u00a0"]) == ["a", ""]
    assert many(spark, T.nfc, ["e\u0301", "abc"]) == ["é", "abc"]


def test_search_tokens(spark):
    assert many(spark, T.search_tokens, ["Foo-bar, BAZ_1 日本語 x日", ""]) == [["foo-bar", "baz_1", "日本語", "x"], []]


def test_title(spark):
    assert many(spark, T.title_of, ["```\n# Head \nx", "\n first\n", ""]) == ["Head", "first", None]


def test_images(spark):
    t = 'a ![x](y) <IMG src=1> <  img\n> data:image/png;base64,AA'
    assert many(spark, T.count_image_references, [t]) == [4]
    assert many(spark, T.strip_image_references, [t]) == ["a    [removed-base64-image],AA"]


def brute_fence(md):
    inside, n = False, 0
    for line in md.split("\n"):
        m = re.match(r"^(`{3,})(\s*\S.*)?$", line)
        if m and not inside:
            inside, n = True, len(m[1])
        elif m and m[2] is None and len(m[1]) >= n:
            inside = False
    return int(inside)


def test_fences(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["```", "````", "```py", "x", "", "```  ", "`"]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    assert many(spark, T.unclosed_fence, texts) == [brute_fence(t) for t in texts]
    assert many(spark, lambda c: T.code_fence(c, F.lit("py")), ["a```b\n\n"]) == ["````py\na```b\n````"]


def test_image_format(spark):
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF1234WEBP", b"II*\x00", b"<svg xmlns", b"data:image/png;base64,", b"abc"]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, c binary")
    assert [r[0] for r in df.orderBy("i").select(T.image_format(F.col("c"))).collect()] == ["png", "jpeg", "webp", "tiff", "svg", "data-uri", "unknown"]


def test_line_numbers(spark):
    assert many(spark, C.strip_line_numbers, ["1  a\n\n2    b", "1 a\nb", "1 a", "10\tx\n11\ty"]) == ["a\n\nb", "1 a\nb", "1 a", "x\ny"]


def test_split_merged(spark):
    got = many(spark, lambda c: C.split_merged(c), ["importrequests\nximportos", "importos; fromsys", "plain", ""])
    assert [g.text for g in got] == ["import requests\nximportos", "import os; from sys", "plain", ""]
    assert got[1].done == ["split:importos->import os", "split:fromsys->from sys"]


def test_ascii_punctuation(spark):
    assert many(spark, C.ascii_punctuation, ["print（１）；", "你好，世界。"]) == ["print(１);", "你好，世界。"]


def test_indentation(spark):
    t = "def f():\nreturn 1\nif x {\ny\n}\n  kept\n\nz"
    assert many(spark, C.recover_indentation, [t, "plain\ntext", None])[0] == "def f():\n    return 1\n    if x {\n        y\n    }\n  kept\n\n    z"


def brute_terminal(text):
    out, role, buf, last = [], None, [], None
    for line in text.split("\n"):
        m = re.match(r"^\s*(?:\$|>>|>)\s?(.*)$", line)
        if m or role != "output":
            if role:
                out.append((role, "\n".join(buf), last if role == "output" else None))
                last = buf[0] if role == "command" else last
            role, buf = ("command", [m[1]]) if m else ("output", [line])
        else:
            buf.append(line)
    out.append((role, "\n".join(buf), last if role == "output" else None))
    return out


def test_terminal_panels(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["$ ls -l", "> x", "out", "", "more out"]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts = [t for t in texts if t]
    got = many(spark, C.terminal_panels, texts)
    for t, g in zip(texts, got):
        want = brute_terminal(t)
        assert [(s.role, s.text) for s in g] == [w[:2] for w in want], t
        assert [s.command for s in g if s.role == "output"] == [w[2] for w in want if w[0] == "output"], t


def test_http_and_diff_panels(spark):
    t = "GET /a HTTP/1.1\nHost: x\nA: b\n\nbody\n\nend\nHTTP/1.1 200 OK\n\nhello"
    got = many(spark, C.http_panels, [t, "lead\nGET / HTTP/1.1", ""])
    assert [(s.role, s.text) for s in got[0]] == [
        ("request_line", "GET /a HTTP/1.1"), ("request_header", "Host: x\nA: b"), ("request_body", "body\n\nend"), ("status_line", "HTTP/1.1 200 OK"), ("response_body", "hello"),
    ]
    assert [(s.role, s.text) for s in got[1]] == [("response_body", "lead"), ("request_line", "GET / HTTP/1.1")]
    assert got[2] == []
    d = "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b"
    assert [(s.role, s.text) for s in many(spark, C.diff_panels, [d])[0]] == [("file_header", "--- a/x"), ("file_header", "+++ b/x"), ("hunk_header", "@@ -1,2 +1,2 @@"), ("hunk_content", "-a\n+b")]


@pytest.mark.parametrize(
    ("text", "kind", "lang"),
    [
        ("POST /x HTTP/1.1", "http", "http"), ("--- a\n+++ b", "diff", "diff"), ("Traceback (most recent call last)", "stack_trace", "log"), ("2024-01-01 10:00:00 x", "log", "log"), ("$ ls", "terminal", "bash"),
        ("[a]\nb=1", "configuration", "ini"), ('{"a": 1}', "configuration", "json"), ("a: b", "configuration", "yaml"), ("def f(x)", "code", "python"), ("func main()", "code", "go"), ("", "code", None),
    ],
)
def test_classify(spark, text, kind, lang):
    assert one(spark, C.classify_text(F.col("t")), t=text) == kind
    assert one(spark, C.detect_language(F.col("t"), F.lit(kind)), t=text) == lang


def test_structural(spark):
    texts = ["", "(a[b]{c})", "(((", ")(", "plain words here"]
    assert many(spark, C.bracket_balance, texts) == [0.0, 1.0, 0.0, 0.0, 0.5]
    good, bad = many(spark, lambda c: C.structural_score(c, F.lit("code")), ["import os\nfor x in y:\n    print(x)", "importosforxiny"])
    assert good > bad


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_metrics(spark):
    rng = random.Random(5)
    words = ["äb", "c", "(x)", "1²", "\n", " ", "日"]
    pairs = [("".join(rng.choice(words) for _ in range(rng.randint(0, 12))), "".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame([(i, g, a) for i, (g, a) in enumerate(pairs)], "i int, g string, a string")
    g, a = F.col("g"), F.col("a")
    rows = df.select(M.cer(g, a).alias("cer"), M.line_metrics(g, a)["missing_line_count"].alias("miss"), M.hallucination_rate(g, a).alias("h"), M.digit_accuracy(g, a).alias("dig"), "i").orderBy("i").collect()
    for (gold, act), r in zip(pairs, rows):
        assert r.cer == pytest.approx((0.0 if not act else 1.0) if not gold else levenshtein(gold, act) / len(gold))
        assert r.miss == sum(x not in set(act.splitlines()) for x in gold.splitlines())
        odd = sum(c not in set(gold) and not (c.isspace() and any(x.isspace() for x in gold)) for c in act)
        assert r.h == pytest.approx(odd / len(act) if act else 0.0)
        n, m = sum(c.isdigit() for c in gold), sum(c.isdigit() for c in act)
        assert r.dig == pytest.approx((1.0 if m == 0 else 0.0) if n == 0 else 1 - abs(n - m) / max(n, m))


def test_what_a_comma_may_be_taken_for(spark):
    from quirewright.functions import metrics

    df = spark.createDataFrame([("a,b", "a，b"), ("a,b", "a.b"), ("a.b", "a,b")], "gold string, actual string")
    assert [r[0] for r in df.select(metrics.hallucination_rate(F.col("gold"), F.col("actual"))).collect()] == [0.0, 1 / 3, 0.0]
