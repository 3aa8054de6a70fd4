"""HTML pages to ordered blocks and images.

Parsing is inherently stateful, so it runs in Arrow batches over the pages, with the standard library's tokenizer
and a tree that closes what HTML lets stand open. Everything that is not parsing (best URL, decorative images, absolute
URLs) is column expressions over the result.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags, selectors and hints that steer extraction.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript iframe svg math form button".split())
ARTICLE = (("tag", "article"), ("tag", "main"), ("role", "main"), ("id", "main"), ("id", "content"), ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"), ("class", "markdown-body"))
TYPES = {"p": "paragraph", "pre": "native_code", "ul": "list", "ol": "list", "blockquote": "quote", "table": "table", "hr": "horizontal_rule", "figure": "visual", "img": "visual", "picture": "visual"}
WRAPPED = set("pre table ul ol blockquote figure h1 h2 h3 h4 h5 h6".split())
LANGUAGES = set("python py bash shell sh javascript js typescript ts c cpp c++ go rust java ruby php sql json yaml toml ini xml html css http diff".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
SHOT = ("screenshot of", "code screenshot", "code block", "screenshot above", "image of code")
DECORATIVE_CLASS = ("emoji", "icon", "avatar", "logo", "decoration", "deco", "sprite", "ad-", "ad_", "advert")
DECORATIVE_ALT = ("icon", "avatar", "logo", "decoration")
TINY = 32


class Node:
    """An element of the tree; text nodes are plain strings among its children."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, *tags: str) -> list[Node]:
        """Elements below with one of the tags."""
        return [n for n in self.walk() if n.tag in tags]

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def strings(self):
        """Text nodes below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            else:
                yield c

    def text(self) -> str:
        """Visible text: every text node stripped, one per line, at most one blank line in a row."""
        kept = [s for s in (x.strip() for x in self.strings()) if s]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.at = self.root

    def _close(self, tags: set, scopes: set) -> None:
        n = self.at
        while n.parent is not None and n.tag not in scopes:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], SCOPES[tag])
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def article_root(tree: Node) -> Node:
    """The first element that the article selectors find, in their order, else the body, else all."""
    body = next(iter(tree.all("body")), tree)
    nodes = list(body.walk())
    for kind, value in ARTICLE:
        for n in nodes:
            if (kind == "tag" and n.tag == value) or (kind == "class" and value in n.classes) or (kind in ("id", "role") and n.attrs.get(kind) == value):
                return n
    return body


def selector(n: Node) -> str:
    """id, else tag with classes, else tag with its place among siblings of its kind."""
    if n.attrs.get("id"):
        return f"#{n.attrs['id']}"
    if n.classes:
        return n.tag + "." + ".".join(n.classes)
    if n.parent is None:
        return n.tag
    same = [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag]
    return f"{n.tag}:nth-of-type({same.index(n) + 1})"


def content_children(root: Node):
    """Direct element children that may hold content; a ``div`` around exactly one block, or one paragraph, gives way to it."""
    for c in root.children:
        if not isinstance(c, Node) or c.tag in SKIPPED:
            continue
        names = " ".join(c.classes).lower()
        if "advertisement" in names or "ad-slot" in names:
            continue
        if c.tag == "div":
            inner = c.all(*WRAPPED)
            paragraphs = c.all("p")
            if len(inner) == 1 or (not inner and len(paragraphs) == 1):
                yield (inner or paragraphs)[0]
                continue
        yield c


def code_language(n: Node, text: str) -> str | None:
    """Language by class, else by what the code looks like."""
    for c in (x.lower() for x in n.classes):
        m = re.match(r"(?:language|lang|highlight)-(.+)", c)
        if m or c in LANGUAGES:
            return m[1] if m else c
    if re.search(r"(?m)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD) [^ ]+ HTTP/\d", text):
        return "http"
    if re.search(r"^\s*[@+\\-][^\n]*\n", text):
        return "diff"
    if re.search(r"\bdef\s+\w+\s*\(", text) or "import " in text.split("\n", 1)[0]:
        return "python"
    if text.startswith(("$ ", "> ")) or re.search(r"(?m)^\s*\$\s", text):
        return "bash"
    return None


def copy_payload(n: Node) -> str | None:
    """What a copy button anywhere in the element would put on the clipboard."""
    for b in n.all("button"):
        for key in ("data-copy", "data-clipboard-text", "data-code"):
            if (b.attrs.get(key) or "").strip():
                return b.attrs[key]
        click = b.attrs.get("onclick") or ""
        if "clipboard" in click.lower():
            m = re.search(r"writeText\(\s*['\"](.+?)['\"]\s*\)", click) or re.search(r"['\"](.+?)['\"]\s*\)\s*$", click)
            if m:
                return m[1]
    return None


def hidden_code(n: Node) -> str | None:
    """Text of code that is there for machines only: aria-hidden, not displayed, screen-reader classes, read-only text areas."""
    for c in n.all("code", "pre", "textarea"):
        names = " ".join(c.classes).lower()
        hidden = (
            (c.attrs.get("aria-hidden") or "").lower() == "true"
            or "display:none" in (c.attrs.get("style") or "").lower().replace(" ", "")
            or any(w in names for w in ("sr-only", "visually-hidden", "sr_only"))
            or (c.tag == "textarea" and ("readonly" in c.attrs or "readonly" in names))
        )
        if hidden and c.text():
            return c.text()
    return None


def _srcset_first(s: str | None) -> str | None:
    first = (s or "").split(",", 1)[0].strip().split(" ", 1)[0].strip()
    return first or None


def _size(v: str | None) -> int | None:
    return int(v) or None if v and re.fullmatch(r"\s*[+-]?\d+\s*", v) else None


def images_in(n: Node, base: str) -> list[dict]:
    """Images below an element, with every place a lazy page may keep their URL."""
    out = []
    for img in ([n] if n.tag == "img" else []) + n.all("img"):
        a = img.attrs
        picture = None
        if img.parent is not None and img.parent.tag == "picture":
            picture = next((u for u in (_srcset_first(s.attrs.get("srcset") or s.attrs.get("data-srcset")) for s in img.parent.all("source")) if u), None)
        out.append(
            {
                "src": a.get("src"), "alt": (a.get("alt") or "").strip(), "title": a.get("title"), "selector": f"{base} {selector(img)}",
                "data_src": a.get("data-src") or a.get("data-original") or a.get("data-lazy-src"), "srcset": a.get("srcset") or a.get("data-srcset"),
                "picture_src": picture, "width": _size(a.get("width")), "height": _size(a.get("height")), "classes": img.classes or None,
            }
        )
    return out


def is_code_shot(alt: str) -> bool:
    """Whether an image's text says that it shows code."""
    low = alt.lower().strip()
    return any(h in low for h in SHOT) or low.endswith("above") or low.startswith("screenshot")


def extract(html: str) -> tuple[list[dict], list[dict]]:
    """(blocks, images) of a page. Images of an element come before its own block; images of code that stands there as text give no block."""
    tree = parse(html)
    root = article_root(tree)
    blocks: list[dict] = []
    images: list[dict] = []
    h1 = root.all("h1")
    title = next((t for t in ("".join(n.strings()).strip() for n in tree.all("title")[:1]) if t), None)
    if title and not h1:
        blocks.append({"type": "heading", "text": title, "heading_level": 1})
    after_code = False
    for n in content_children(root):
        kind = "heading" if re.fullmatch(r"h[1-6]", n.tag) else TYPES.get(n.tag, "paragraph")
        sel = selector(n)
        code = origin = None
        inner = next(iter(n.all("code")), None)
        if kind == "native_code":
            code, origin = (copy_payload(n.parent) if n.parent is not None else None), "copy_button"
            if not code:
                code, origin = hidden_code(n), "hidden_accessible"
            if not code:
                code, origin = (inner or n).text(), "pre"
        for img in images_in(n, sel):
            images.append(img)
            if not code and not (after_code and img["alt"] and is_code_shot(img["alt"])):
                blocks.append({"type": "visual", "image": len(images) - 1, "selector": img["selector"]})
        text = n.text() if kind in ("heading", "paragraph", "quote") else None
        made = None
        if kind == "heading":
            made = {"text": text, "heading_level": int(n.tag[1])}
        elif kind in ("paragraph", "quote"):
            made = {"text": text} if text else None
        elif kind == "native_code":
            made = {"text": code, "language": code_language(inner or n, code), "text_source": origin} if code else None
        elif kind == "list":
            items = [c.text() for c in n.children if isinstance(c, Node) and c.tag == "li"]
            made = {"list_items": items} if items else None
        elif kind == "table":
            rows = [r for r in ([c.text() for c in tr.all("td", "th")] for tr in n.all("tr")) if r]
            made = {"table_rows": rows} if rows else None
        elif kind == "horizontal_rule":
            made = {}
        if made is not None:
            blocks.append({"type": kind, "selector": sel, **made})
        if kind == "native_code":
            after_code = bool(code)
        elif kind in ("heading", "list", "quote", "table"):
            after_code = False
    return blocks, images


IMAGE = "struct<src:string,alt:string,title:string,selector:string,data_src:string,srcset:string,picture_src:string,width:int,height:int,classes:array<string>>"
BLOCKS = f"source_ref string, block_order int, block_id string, type string, text string, language string, heading_level int, list_items array<string>, table_rows array<array<string>>, selector string, text_source string, image {IMAGE}"


def _extract(batches):
    import pandas as pd

    names = [f.split(" ")[0] for f in BLOCKS.split(f", image {IMAGE}")[0].split(", ")] + ["image"]
    for pdf in batches:
        rows = []
        for ref, html in zip(pdf["source_ref"], pdf["html"]):
            blocks, images = extract(html)
            for i, b in enumerate(blocks):
                img = images[b["image"]] if "image" in b else None
                rows.append((ref, i, f"b_{i:06d}", b["type"], b.get("text"), b.get("language"), b.get("heading_level"), b.get("list_items"), b.get("table_rows"), b.get("selector"), b.get("text_source"), img))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"block_order": "int32", "heading_level": "Int32"})


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages (source_ref, html). A visual block carries its image; NULL or empty pages give none."""
    made = pages.select("source_ref", "html").mapInPandas(_extract, BLOCKS)
    img = F.col("image")
    reason = decorative_reason(img["classes"], img["alt"], img["width"], img["height"])
    visual = F.col("type") == "visual"
    return made.withColumns(
        {
            "best_url": best_url(F.lit(None).cast("string"), img["data_src"], img["picture_src"], img["src"], img["srcset"]),
            "visual_type": F.when(visual, F.when(reason.isNotNull(), "decorative").otherwise("unknown")),
            "visual_state": F.when(visual, F.when(reason.isNotNull(), "ignored_decorative").otherwise("review_required")),
            "coverage_state": F.when(visual, F.when(reason.isNotNull(), "decorative_with_reason").otherwise("review_required")),
            "coverage_reason": F.when(visual, F.coalesce(reason, F.lit("DOM image; not yet transcribed"))),
        }
    )


# ---- images as columns ------------------------------------------------------------------------------------------


def best_url(current_src: Column, data_src: Column, picture_src: Column, src: Column, srcset: Column) -> Column:
    """The URL to fetch: what the browser chose, then the lazy one, the picture's, the plain one, the first of the set."""
    some = lambda c: F.nullif(c, F.lit(""))
    first = F.trim(F.substring_index(F.trim(F.substring_index(srcset, ",", 1)), " ", 1))
    return F.coalesce(some(current_src), some(data_src), some(picture_src), some(src), some(first))


def decorative_reason(classes: Column, alt: Column, width: Column, height: Column) -> Column:
    """Why an image is decorative: a class, its text, or its size; NULL if nothing says so."""
    names = F.lower(F.array_join(F.coalesce(classes, F.array().cast("array<string>")), " "))
    low = F.lower(F.coalesce(alt, F.lit("")))
    rules = [(names.contains(h), f"class hint '{h}'") for h in DECORATIVE_CLASS] + [(low.contains(h), f"alt hint '{h}'") for h in DECORATIVE_ALT]
    chain = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    tiny = width.between(1, TINY) & height.between(1, TINY)
    return chain.when(tiny, F.concat(F.lit("tiny dimensions "), width.cast("string"), F.lit("x"), height.cast("string")))


def absolute_url(url: Column, base: Column) -> Column:
    """A URL as it is fetched from a page; NULL for embedded data."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(url.startswith("data:"), None)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url.rlike("^https?://"), url)
        .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), url))
    )
