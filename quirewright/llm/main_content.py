"""Page boilerplate mixed with main content (problem 4).

Method: maximum-scoring subsequence. A page is a sequence of blocks and images, each worth the sum of the weights of
its words and tags (container, element, type, links, classes, form of its lines); the weights are the log-odds of a
logistic regression, so words of an article score positive and navigation, notices, sharing and the like negative. A
linear scan finds the contiguous region of greatest sum. One region would keep the advertisements between two paragraphs, so an
item worth less than ``SPLIT`` ends a region, and the scan finds the best region of every stretch between two such items: several
disjoint regions. A region counts if it is worth ``LEAST_GAIN``. What lies in no region isn't the article's own; no item is judged by itself.

Labels are made, not given: on pages whose markup names its parts, the container that holds most of the
prose is taken for the body and the others not; containers that hold everything on other pages tell nothing
and their items are unlabelled. Training reads at most ``TRAIN_PAGES`` pages, ``TRAIN_BLOCKS`` blocks and ``TRAIN_IMAGES`` images.

Scale: items are scored in a map; only (document, place, score) is shuffled. The scan is a running sum less its
running minimum, computed in segments of ``SEGMENT`` places and then over the segments' sums, so a document with
a third of all rows is many groups.

Cases: NULL text scores by its tags; documents with one item are judged by it; repeated rows count once; blocks without an
order stand, by a hash of their id, before the others; an image stands amid the blocks of its container or, without
any, at the number its selector tells, else first. With no labelled pages built-in tag weights are used.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.cluster import hash_sample, key_join, materialize

WEB = ("url", "html")
#: Bounds on what training reads.
TRAIN_PAGES, TRAIN_BLOCKS, TRAIN_IMAGES = 2000, 60_000, 20_000
#: Places in a segment of the scan, and the bound on one item's part of the sum.
SEGMENT, CLIP = 512, 6.0
#: An item worth less ends a region; a region worth less is none.
SPLIT, LEAST_GAIN = -2.0, 1.5
_NTH = re.compile(r":nth-(?:of-type|child)\(\d+\)")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_NAME = re.compile(r"@?(?:[A-ZÀ-Þ][\w'-]+)(?: [A-ZÀ-Þ][\w'-]+){1,2}$")
# Weights of tags where nothing could be learned.
PRIOR = {"in:nav": -4.0, "in:aside": -4.0, "in:footer": -4.0, "in:header": -3.0, "in:main": 3.0, "in:article": 3.0, "links>2": -1.0, "prose": 2.0, "bias": 0.5}


#: Columns that tell of an image.
IMAGE_COLUMNS = ("selector", "classes", "alt", "width", "height", "data_src", "current_src", "src")
#: A feature's name, or its name and its value where that isn't 1.
Feature = str | tuple[str, float]


def container(selector: str | None, drop: int = 1) -> str:
    """The selector without its last elements and without positions."""
    parts = _NTH.sub("", selector or "").split(" > ")
    return " > ".join(parts[:-drop])


def _selector_features(selector: str | None, drop: int) -> list[str]:
    parts = _NTH.sub("", selector or "").split(" > ")
    out = ["in:" + p for p in parts[:-drop]]
    out.append("at:" + " > ".join(parts[:-drop]))
    out += ["tag:" + p.split(".")[0].split("#")[0] for p in parts[-drop:]]
    return out


def block_features(kind: str | None, text: str | None, selector: str | None, links: str | None, tags: bool = True) -> list[Feature]:
    """Words and tags of a block. All words count; those of a long line after its first four share the value of four, so that its length doesn't decide."""
    f = ["bias", f"type:{kind}"]
    if tags:
        f += _selector_features(selector, 1)
    n = re.search(r'"links": (\d+)', links or "")
    if n:
        f.append("links" + (">2" if int(n[1]) > 2 else "=" + n[1]))
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return [*f, "blank"]
    prose = ends = colon = 0
    for i, line in enumerate(lines):
        words = _WORD.findall(line)
        alpha = sum(w[0].isalpha() for w in words)
        long = alpha > 14
        end = line[-1]
        ends += end in ".!?。"
        prose += end in ".!?。" and alpha >= 6
        if i == 0 and _NAME.match(line):
            f.append("first is a name" + ("" if len(lines) > 1 else ", alone"))
        m = re.match(r"@?(?:[A-ZÀ-Þ][\w'-]+ ){2}(?:wrote:|[A-ZÀ-Þ])", line)
        if m and i == 0:
            f.append("opens with a name" + ("@" if line[0] == "@" else ""))
        own = list(dict.fromkeys(w.lower() if w[0].isalpha() else "#" if w[0].isdigit() else w for w in words))
        first = len(dict.fromkeys(w.lower() if w[0].isalpha() else "#" if w[0].isdigit() else w for w in words[:4])) if long else len(own)
        f += ["w:" + t for t in own[:first]]
        f += [("w:" + t, min(1.0, 4 / (len(own) - first))) for t in own[first:]]
        for k in range(min(3, len(words))):
            a = words[k]
            f.append(f"{k}:" + (a.lower() if a[0].isalpha() else "#" if a[0].isdigit() else a))
        if re.match(r"[\w-]+ \d+\.\d+[\w.]*:", line):
            colon += 1
    f += [f"lines:{min(len(lines), 4)}", "prose" if prose else "no prose", f"ended:{round(4 * ends / len(lines))}", f"{kind}/ended:{round(2 * ends / len(lines))}"]
    if colon == len(lines):
        f.append("entries")
    if len(lines) == 1:
        f.append(f"{kind}/size:{min(len(lines[0]) // 40, 4)}")
    if prose > 1:
        f.append("much prose")
    return f


def image_features(row: dict) -> list[str]:
    """What tells of an image: where it stands, its classes, words, size and source."""
    f = ["bias", *_selector_features(row.get("selector"), 2)]
    classes = row.get("classes")
    names = [c.strip().lower() for c in classes if c and c.strip()] if classes is not None else []
    f += ["class:" + c for c in names if not re.fullmatch(r"css-[0-9a-f]+", c)] or ["no class"]
    alt = (row.get("alt") or "").strip().lower()
    f.append("alt:" + ("none" if not alt else alt if len(alt) < 8 else "long" if len(alt) > 25 else "some"))
    for side in ("width", "height"):
        v = row.get(side)
        f.append(f"{side}:" + ("none" if v is None or v != v else "tiny" if v <= 2 else "icon" if v <= 64 else "small" if v <= 200 else "large"))
    src = next((row[k] for k in ("data_src", "current_src", "src") if row.get(k) and not str(row[k]).startswith("data:")), "")
    f.append("src:" + re.sub(r"[-_0-9a-f]*\.\w+$", "", src.rsplit("/", 1)[-1].lower()))
    return f


def _valued(x: Feature) -> tuple[str, float]:
    return (x, 1.0) if isinstance(x, str) else x


class Weights(dict):
    """Feature -> weight; unseen features weigh nothing."""

    def score(self, features: list[Feature]) -> float:
        return float(sum(self.get(x, 0.0) * v for x, v in map(_valued, features)))


def fit(samples: list[tuple[list[Feature], bool]], rounds: int = 250, least: int = 3) -> Weights:
    """Logistic regression with Adagrad over features seen ``least`` times; the built-in weights if a class is missing."""
    labels = np.array([y for _, y in samples], float)
    if len(samples) < 20 or labels.min() == labels.max():
        return Weights(PRIOR)
    count = Counter(x for f, _ in samples for x in {_valued(x)[0] for x in f})
    ids = {x: i for i, x in enumerate(sorted(k for k, n in count.items() if n >= least))}
    rows, cols, vals = [], [], []
    for i, (f, _) in enumerate(samples):
        for x, v in map(_valued, f):
            if x in ids:
                rows.append(i)
                cols.append(ids[x])
                vals.append(v)
    r, c, v = np.array(rows), np.array(cols), np.array(vals)
    w, g2 = np.zeros(len(ids)), np.full(len(ids), 1e-6)
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    for _ in range(rounds):
        z = np.bincount(r, w[c] * v, len(labels))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.bincount(c, d[r] * v, len(ids)) + 2e-5 * w
        g2 += grad**2
        w -= 0.3 * grad / np.sqrt(g2)
    return Weights({x: float(w[i]) for x, i in ids.items() if abs(w[i]) > 1e-3})


def body_containers(pages: dict[str, list[tuple[str, str]]]) -> tuple[set[str], set[str]]:
    """(body, generic) containers from (container, text) of pages: where the prose is, and those that hold all of some pages."""
    whole, votes, seen = Counter(), Counter(), Counter()
    for blocks in pages.values():
        n = Counter(c for c, _ in blocks)
        top, k = n.most_common(1)[0]
        if k >= 0.9 * len(blocks) and len(blocks) >= 5:
            whole[top] += 1
    generic = {c for c, k in whole.items() if k >= max(3, 0.02 * len(pages))}
    for blocks in pages.values():
        mass = defaultdict(int)
        for c, t in blocks:
            mass[c] += sum(len(x) for x in re.findall(r"[^\n]{30,}[.!?。]", t or ""))
        own = {c: m for c, m in mass.items() if c not in generic}
        if len(own) >= 3:
            votes[max(own, key=lambda c: (own[c], c))] += 1
            seen.update(own.keys())
    return {c for c in seen if votes[c] > 0.5 * seen[c]}, generic


def _sample(web: DataFrame, pages: int) -> list:
    """At most ``TRAIN_BLOCKS`` blocks of at most ``pages`` pages, both chosen by hash."""
    ids = hash_sample(materialize(web.select("document_id").where("document_id is not null").distinct(), "pages"), ["document_id"], pages)
    cols = web.select("document_id", "block_id", "type", "text", F.col("evidence")[0]["selector"].alias("selector"), "extra").where("document_id is not null")
    own = materialize(cols.join(F.broadcast(ids), "document_id").distinct(), "page-blocks")
    return sorted(hash_sample(own, ["document_id", "block_id", "text"], TRAIN_BLOCKS).drop("block_id").distinct().collect(), key=str)


def train(blocks: DataFrame, images: DataFrame | None = None, pages: int = TRAIN_PAGES) -> tuple[Weights, Weights]:
    """Weights for blocks and images from at most ``pages`` pages whose markup names its parts."""
    rows = _sample(blocks.where(F.col("source_kind").isin(*WEB)), pages)
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r.document_id].append((container(r.selector), r.text))
    body, generic = body_containers(by)
    named = {d for d, b in by.items() if len({c for c, _ in b} - generic) >= 3}
    samples = []
    for r in rows:
        c = container(r.selector)
        if r.document_id in named and c not in generic:
            f = block_features(r.type, r.text, r.selector, r.extra)
            samples.append((f, c in body))
            # once more as a page without named parts would show it
            samples.append((block_features(r.type, r.text, "", r.extra), c in body))
    weights = fit(samples)
    if images is None:
        return weights, Weights(PRIOR)
    ids = blocks.sparkSession.createDataFrame([(d,) for d in sorted(named)], "document_id string")
    shown = materialize(images.select("document_id", "image_id", *IMAGE_COLUMNS).join(F.broadcast(ids), "document_id").distinct(), "page-images")
    pics = sorted(hash_sample(shown, ["document_id", "image_id"], TRAIN_IMAGES).collect(), key=str)
    labelled = []
    for p in pics:
        c = container(p.selector, 2)
        if c not in generic:
            labelled += [(image_features(p.asDict()), c in body), (image_features({**p.asDict(), "selector": " > ".join((p.selector or "").split(" > ")[-2:])}), c in body)]
    return weights, fit(labelled)


def _container(selector: Column, drop: int) -> Column:
    """Hash of :func:`container` of a column of selectors."""
    parts = F.split(F.regexp_replace(F.coalesce(selector, F.lit("")), _NTH.pattern, ""), " > ")
    return F.xxhash64(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - drop, F.lit(0))), " > "))


def score_blocks(blocks: DataFrame, weights: Weights) -> DataFrame:
    """(document_id, item_id, image, place, inside, score) of every block of a web document; ``inside`` is a hash of its container."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for kind, text, selector, extra in batches:
            yield pd.Series([weights.score(block_features(*x)) for x in zip(kind, text, selector, extra)], dtype="float64")

    web = blocks.where(F.col("source_kind").isin(*WEB) & F.col("document_id").isNotNull() & F.col("block_id").isNotNull())
    selector = F.col("evidence")[0]["selector"]
    unordered = F.lit(-1) - F.pmod(F.xxhash64("block_id"), F.lit(1 << 20))
    return web.select(
        "document_id", F.col("block_id").alias("item_id"), F.lit(False).alias("image"), F.coalesce("block_order", unordered).cast("double").alias("place"),
        _container(selector, 1).alias("inside"), score("type", "text", selector, "extra").alias("score"),
    )


def score_images(images: DataFrame, scored: DataFrame, weights: Weights) -> DataFrame:
    """(document_id, item_id, image, place, score) of every image, placed amid the ``scored`` blocks of its container."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([weights.score(image_features(r)) for r in pdf.to_dict("records")], dtype="float64")

    shown = images.where("image_id is not null").select(
        "document_id", F.col("image_id").alias("item_id"), F.lit(True).alias("image"), _container(F.col("selector"), 2).alias("inside"),
        F.nullif(F.regexp_extract("selector", r".*:nth-(?:of-type|child)\((\d+)\) > [^>]+$", 1), F.lit("")).cast("double").alias("told"), score(F.struct(*IMAGE_COLUMNS)).alias("score"),
    )
    spans = scored.groupBy("document_id", "inside").agg(((F.min("place") + F.max("place")) / 2).alias("middle"))
    return key_join(shown, spans, ["document_id", "inside"], "left").select(
        "document_id", "item_id", "image", (F.coalesce("middle", "told", F.lit(-1.0)) + 0.5).alias("place"), "score"
    )


def in_regions(scored: DataFrame, segment: int = SEGMENT, split: float = SPLIT, least: float = LEAST_GAIN) -> DataFrame:
    """``scored`` (document_id, item_id, place, score, ...) with ``own``: whether the item lies in a region of its document.

    Items worth less than ``split`` part the document into stretches; in each, the region ends where the running sum less
    the least running sum before it is greatest, and begins after that least sum. Documents are cut into segments of ``segment`` places; a
    second scan runs over the segments' sums only.
    """
    cut = F.col("score") < split
    order = ["place", "image", "item_id"]
    base = scored.withColumn("seg", F.floor(F.col("place") / segment)).withColumn("v", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), "score")))
    upto = W.partitionBy("document_id", "seg").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("part", F.sum(F.when(cut, 1).otherwise(0)).over(upto))
    # a part's rows follow each other, so its running sums continue in the order of the segment
    inside = W.partitionBy("document_id", "seg", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    at = F.struct(*order)
    run = base.withColumn("v", F.when(cut, 0.0).otherwise(F.col("v"))).withColumn("at", at).withColumn("cum", F.sum("v").over(inside))
    run = run.withColumn("low", F.min(F.when(~cut, F.struct((F.col("cum") - F.col("v")).alias("p"), "at"))).over(inside))
    kept = run.where(~cut)
    sums = kept.groupBy("document_id", "seg", "part").agg(
        F.sum("v").alias("total"),
        F.max_by(F.struct((F.col("cum") - F.col("low.p")).alias("gain"), F.col("low.at").alias("first"), F.col("at").alias("last")), F.struct(F.col("cum") - F.col("low.p"), -F.col("place"))).alias("own"),
        F.max_by(F.struct("cum", F.col("at").alias("last")), F.struct("cum", -F.col("place"))).alias("head"),
        F.min(F.struct((F.col("cum") - F.col("v")).alias("p"), F.col("at").alias("first"))).alias("dip"),
    )
    # separators alone in their part leave no row, so a stretch is told by the parts' numbers
    cuts = base.groupBy("document_id", "seg").agg(F.max("part").alias("cuts"))
    number = W.partitionBy("document_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    cuts = cuts.withColumn("before_seg", F.coalesce(F.sum("cuts").over(number), F.lit(0)))
    sums = sums.join(cuts.hint("merge"), ["document_id", "seg"]).withColumn("stretch", F.col("before_seg") + F.col("part"))
    over = W.partitionBy("document_id", "stretch").orderBy("seg")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    sums = sums.withColumn("before", F.min(F.struct((F.col("base") + F.col("dip.p")).alias("p"), F.col("dip.first").alias("first"))).over(before))
    across = F.when(
        F.col("before").isNotNull(),
        F.struct((F.col("base") + F.col("head.cum") - F.col("before.p")).alias("gain"), F.col("before.first").alias("first"), F.col("head.last").alias("last")),
    )
    best = sums.withColumn("r", F.when(across["gain"] > F.col("own.gain"), across).otherwise(F.col("own")))
    whole = W.partitionBy("document_id", "stretch")
    best = best.withColumn("r", F.max_by("r", F.struct(F.col("r.gain"), -F.col("r.last.place"))).over(whole)).select("document_id", "seg", "part", "r")
    found = run.join(best.hint("merge"), ["document_id", "seg", "part"], "left")
    own = ~cut & (F.col("r.gain") >= least) & (F.col("at") >= F.col("r.first")) & (F.col("at") <= F.col("r.last"))
    return found.select(*scored.columns, F.coalesce(own, F.lit(False)).alias("own"))


def judged(blocks: DataFrame, images: DataFrame | None = None, weights: tuple[Weights, Weights] | None = None) -> DataFrame:
    """(document_id, item_id, image, place, score, own): whether each block and image belongs to its article's own body."""
    block_weights, image_weights = weights or train(blocks, images)
    cols = ["document_id", "item_id", "image", "place", "score"]
    scored = materialize(score_blocks(blocks, block_weights).distinct(), "scored")
    items = scored.select(*cols)
    if images is not None:
        items = materialize(items.unionByName(score_images(images, scored, image_weights).select(*cols).distinct()), "items")
    return in_regions(items)


def boilerplate(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, item_id): blocks and images of web documents that aren't part of the article's own body."""
    return judged(blocks, images).where(~F.col("own")).select("document_id", "item_id").distinct()


def main_blocks(blocks: DataFrame, images: DataFrame | None = None, weights: tuple[Weights, Weights] | None = None) -> DataFrame:
    """The rows of ``blocks`` that are their web article's own body, all columns kept."""
    own = judged(blocks, images, weights).where("own and not image").select("document_id", F.col("item_id").alias("block_id")).distinct()
    return key_join(blocks.where(F.col("source_kind").isin(*WEB)), own, ["document_id", "block_id"], "left_semi")
