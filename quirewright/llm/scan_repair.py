"""Noise in text from scanned pages (problem 5).

Method. Corrections: candidates for a suspicious token come from an inverted join on the deletion
neighbourhoods of stroke forms (forms within one edit of each other share a member, so none is missed, which holds of no fixed number of a token's
q-grams; the q-grams they share are a feature), gradient-boosted trees rank them. Lines: one boosted classifier judges pairs of line ends (is the mark
at the break part of the word), another decides whether a short line is furniture (running header, footer, page number) from its form, its
place in the page's box where it has one, and from how it pairs with lines of the same signature on the document's other pages: on
how many it recurs, and whether its number goes on with theirs.

Training is bounded and needs no outside labels: raw and selected texts of the same visual (``TRAIN_ROWS``, at most ``TRAIN_PAIRS`` of their candidates)
and misreadings made from frequent words train the ranker, frequent words broken at random places and frequent compounds the line-pair classifier
(``TRAIN_WORDS`` of each; their fragments' counts come from the whole vocabulary), short lines whose place on the page is known the furniture
classifier (``TRAIN_LINES``), each once with its box and once as if it had none.

Scale: texts are read twice, once for tokens and breaks (written as arrays), once for short lines. The vocabulary is a partial aggregate over all
records; candidates are joined per distinct token, never per record; statistics of lines are per (document, signature). A word may
correct a token if it is ``RATIO`` times as frequent, at any size of the corpus. Paragraphs over several records are found on the records' first and last characters, in
page ranges whose seams are looked up; a whole text is shuffled once, with its notes, and only parts of such paragraphs once more.

Cases: NULL and blank texts have no defects; records without a box are judged by form and recurrence; repeated rows
count once; code is not prose, so it has neither broken nor misread words.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.cluster import hash_sample, key_join, lookup_join, materialize
from quirewright.llm.boosting import Boosted
from quirewright.llm.lookalikes import CYRILLIC, GREEK, canonical_text
from quirewright.operators.pages import page_columns

#: Bounds on what training reads, least count of a word that examples are made from, and how much more frequent than a token its correction must be.
TRAIN_ROWS, TRAIN_PAIRS, TRAIN_WORDS, TRAIN_LINES = 2000, 100_000, 3000, 20_000
SUPPORT, RATIO = 10, 8
#: Margins as shares of the page height, the longest furniture line, height of a page where it is not told.
TOP, BOTTOM, LONGEST, HEIGHT = 0.085, 0.89, 80, 842.0

# Characters that scanners confuse, each written as the strokes it is taken for.
STROKES = {
    "0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "j": "i", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "8": "b", "@": "a", "e": "c", "2": "z",
    "m": "rn", "w": "vv", "u": "ii", "h": "ii", "d": "ci", "ﬁ": "fi", "ﬂ": "fi",
}
# Misreadings of whole groups, to make examples from.
GROUPS = (("m", "rn"), ("w", "vv"), ("u", "ii"), ("li", "h"), ("fi", "ﬁ"), ("d", "cl"))
OTHER_SCRIPTS = frozenset(v.lower() for script in (CYRILLIC, GREEK) for v in script.values())
# Marks that break a word at a line end.
MARKS = "-‐­¬"
_ROMAN = re.compile(r"(?i)^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")


def shape_key(token: str) -> str:
    """A token as strokes: equal for tokens that a scanner may confuse."""
    return "".join(STROKES.get(c, c) for c in token)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance, or ``most`` + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def records(page_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, record_id, document_id, page, text, prose, band, top, low, spot): every text of a PDF document.

    ``band`` is 1 in the margins, 0 in the body, NULL where the record has no box; ``top`` and ``low`` are the box's edges as shares of the page height. ``prose`` is false for code. ``spot``
    places a record among its document's: layer and, by the box, page, right half of the page, top and left of a page block, the order of a block; NULL where there is none.
    """
    spot = lambda known, layer, *k: F.when(known, F.struct(layer.alias("layer"), *[x.cast("double").alias(f"k{i}") for i, x in enumerate(k)]))
    box, zero = F.col("bbox"), F.lit(0.0)
    boxed = lambda box, value: F.when(F.size(box) >= 4, value)
    edges = lambda box, height: [boxed(box, F.when((box[1] < height * TOP) | (box[1] > height * BOTTOM), 1).otherwise(0)).alias("band"), boxed(box, box[1] / height).alias("top"), boxed(box, box[3] / height).alias("low")]
    tall = F.coalesce(F.nullif("page_height", F.lit(0.0)), F.lit(HEIGHT))
    a = page_blocks.where("text is not null and pb_id is not null").select(
        F.lit("page_block").alias("place"), F.col("pb_id").cast("string").alias("record_id"), "document_id", "page", "text",
        (~F.coalesce("is_code_like", F.lit(False))).alias("prose"), *edges(F.col("bbox"), tall),
        spot((F.size("bbox") >= 4) & F.col("page").isNotNull(), F.coalesce("from_ocr_layer", F.lit(False)), F.col("page"), (box[0] + box[2]) / 2 > F.col("page_width") * 0.6, box[1], box[0]).alias("spot"),
    )
    pdf = blocks.where("source_kind = 'pdf'")
    key = F.concat_ws("/", "document_id", "block_id")
    page = F.coalesce("page", F.col("evidence")[0]["page"])
    b = pdf.where("text is not null").select(
        F.lit("block").alias("place"), key.alias("record_id"), "document_id", page.alias("page"), "text",
        (F.col("type") != "native_code").alias("prose"), *edges(F.col("evidence")[0]["bbox"], F.lit(HEIGHT)),
        spot(F.col("block_order").isNotNull(), F.lit(False), F.col("block_order"), zero, zero, zero).alias("spot"),
    )
    c = pdf.where("enrichment.raw_text is not null").select(
        F.lit("enrichment").alias("place"), key.alias("record_id"), "document_id", page.alias("page"), F.col("enrichment.raw_text").alias("text"),
        F.col("enrichment.raw_text").rlike(r"(?:[\p{L}@|0-9-]{2,}[ \n]){6}").alias("prose"), F.lit(None).cast("int").alias("band"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("low"),
        spot(F.lit(False), F.lit(False), zero, zero, zero, zero).alias("spot"),
    )
    return a.unionByName(b).unionByName(c).where(F.col("text").rlike(r"\S"))


# ---- vocabulary -------------------------------------------------------------------------------------------------


_LETTER = r"[\p{L}\p{N}@|]"


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}@|]+")


def wordlike(token: Column) -> Column:
    """Whether a token can be a word, read well or badly: of three letters or more, mostly letters."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    return (F.length(token) >= 3) & (letters >= 2) & (letters * 3 >= F.length(token) * 2 - 1)


def facts(recs: DataFrame) -> DataFrame:
    """(place, record_id, tokens, compounds, breaks): what of every record of prose the corpus and the word defects are read from, taken from its text in one pass.

    ``breaks`` lists (left, mark, right): words that end with a mark at a line end or, with an empty ``right``, at the end of the record; their
    parts are not among the ``tokens``.
    """
    text = F.col("text")
    at_end = text.rlike(rf"[{MARKS}][ \t]*(?:\n|\s*$)")
    none = F.array().cast("array<string>")
    whole = F.when(at_end, F.regexp_replace(text, rf"{_LETTER}+[{MARKS}][ \t]*(?:\n\s*{_LETTER}+|$)", " ")).otherwise(text)
    compounds = F.when(text.rlike(r"\p{L}-\p{L}"), F.regexp_extract_all(F.lower(whole), F.lit(r"(?<![\p{L}\p{N}-])(\p{L}+-\p{L}+)"), F.lit(1))).otherwise(none)
    spans = F.when(at_end, F.regexp_extract_all(text, F.lit(rf"((?i){_LETTER}+[{MARKS}][ \t]*(?:\n\s*{_LETTER}+|\s*$))"), F.lit(1))).otherwise(none)
    pattern = rf"(?i)({_LETTER}+)([{MARKS}])[ \t]*(?:\n\s*({_LETTER}+)|\s*$)"  # read again, since a pattern gives one group at a time
    parts = F.transform(spans, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("left"), F.regexp_extract(x, pattern, 2).alias("mark"), F.lower(F.regexp_extract(x, pattern, 3)).alias("right")))
    breaks = F.filter(parts, lambda x: x["left"].rlike(r"\p{L}") & ((x["right"] == "") | x["right"].rlike(r"\p{L}")))
    return recs.where("prose").select("place", "record_id", _tokens(whole).alias("tokens"), compounds.alias("compounds"), breaks.alias("breaks"))


def vocabulary(told: DataFrame) -> DataFrame:
    """(token, n): words of prose, compounds with a hyphen, and ``first-`` for the first part of a compound; words broken over lines are left out."""
    words = told.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = words.where(wordlike(F.col("token")))
    compounds = told.select(F.explode("compounds").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    firsts = compounds.groupBy(F.concat(F.substring_index("token", "-", 1), F.lit("-")).alias("token")).agg(F.sum("n").alias("n"))
    return words.unionByName(compounds).unionByName(firsts)


# ---- misread words ----------------------------------------------------------------------------------------------


def _grams(key: str) -> list[str]:
    padded = f"^{key}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def deletion_keys(key: str) -> list[int]:
    """Hashes of a string and of what is left of it without any one character, in linear time.

    Two strings within edit distance 1 share at least one of these; strings that share one are at distance 2 at most.
    """
    n = len(key)
    powers, before, after = [1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i, c in enumerate(key):
        powers[i + 1] = powers[i] * _BASE % _PRIME
        before[i + 1] = (before[i] * _BASE + ord(c) + 1) % _PRIME
    for i in range(n - 1, -1, -1):
        after[i] = ((ord(key[i]) + 1) * powers[n - 1 - i] + after[i + 1]) % _PRIME
    return sorted({before[n], *((before[i] * powers[n - 1 - i] + after[i + 1]) % _PRIME for i in range(n))})


def pair_features(token: str, word: str, n: float, m: float) -> list[float]:
    """What tells that ``token`` (seen ``n`` times) is a misreading of ``word`` (seen ``m`` times)."""
    a, b = shape_key(token), shape_key(word)
    ga, gb = set(_grams(a)), set(_grams(b))
    odd = sum(not c.isalpha() or c in "ﬁﬂ" for c in token)
    return [
        math.log(m / max(n, 1)), distance(token, word), float(a == b), distance(a, b), odd, len(token), len(ga & ga & gb) / max(1, len(ga | gb)),
        float(token[:1] == word[:1]), float(token[-1:] == word[-1:]), float(len(word) - len(token)),
    ]


def _near(token: str, word: str) -> bool:
    """Whether a token may be a misreading of a word. A word with a number run into it is none, nor is one in look-alike letters of another script."""
    if token.strip("0123456789") == word or any(c in OTHER_SCRIPTS or "\uff00" <= c <= "\uffef" for c in token):
        return False
    most = max(3, len(word) // 3)
    return distance(shape_key(token), shape_key(word), 1) <= 1 and distance(token, word, most) <= most


def candidates(vocab: DataFrame) -> DataFrame:
    """(token, n, word, m): all words, more frequent by far, that a token is near to in form."""

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: deletion_keys(shape_key(t)))

    single = materialize(vocab.where(~F.col("token").contains("-")).withColumn("keys", keys("token")), "keys")
    words = single.where((F.col("n") >= RATIO) & F.col("token").rlike(r"^\p{L}+$") & ~F.col("token").rlike("[ﬁﬂ]"))
    words = words.select(F.explode("keys").alias("key"), F.col("token").alias("word"), F.col("n").alias("m"))

    @F.pandas_udf("boolean")
    def near(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([_near(a, b) for a, b in zip(token, word)], dtype=bool)

    # a key is shared by no more forms than one inserted character makes of it
    pairs = single.select("token", "n", F.explode("keys").alias("key")).join(words.hint("merge"), "key").where((F.col("m") >= F.col("n") * RATIO) & (F.col("token") != F.col("word")))
    return pairs.select("token", "n", "word", "m").distinct().where(near("token", "word"))


def _misread(word: str, rng: random.Random) -> str | None:
    """A word as a scanner might misread it, in one to three places."""
    for _ in range(rng.choice((1, 1, 2, 3))):
        ways = [(i, 1, k) for i, c in enumerate(word) for k, v in STROKES.items() if len(v) == 1 and (v == c or STROKES.get(c) == v) and k != c]
        ways += [(i, 1, STROKES[c]) for i, c in enumerate(word) if len(STROKES.get(c, "")) == 1 and STROKES[c].isalpha()]
        ways += [(word.index(x), len(x), y) for a, b in GROUPS for x, y in ((a, b), (b, a)) if x in word]
        if not ways:
            return None
        i, n, new = rng.choice(ways)
        word = word[:i] + new + word[i + n :]
    return word


def train_ranker(recs_pdf: DataFrame, pairs: DataFrame, vocab: DataFrame) -> Boosted:
    """The ranker of corrections, from raw and selected texts and from made misreadings."""
    import difflib

    rows = recs_pdf.select("enrichment.raw_text", "enrichment.selected_text").where("raw_text is not null and selected_text is not null and raw_text <> selected_text")
    rows = sorted(hash_sample(rows.distinct(), ["raw_text", "selected_text"], TRAIN_ROWS).collect())
    truth: dict[str, str] = {}
    correct: set[str] = set()
    split = re.compile(r"[^\w@|]+")
    for raw, sel in rows:
        a = [w for w in split.split(canonical_text(raw).lower()) if w]
        b = [w for w in split.split(canonical_text(sel).lower()) if w]
        for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op == "equal":
                correct.update(a[i:j])
            elif op == "replace" and j - i == m - k:
                for x, y in zip(a[i:j], b[k:m]):
                    if x != y and distance(x, y, 3) <= 3 and y.isalpha():
                        truth[x] = y
    correct -= truth.keys()
    known = sorted(truth.keys() | correct)
    xs: list[list[float]] = []
    ys: list[int] = []
    if known:
        spark = vocab.sparkSession
        mine = pairs.join(F.broadcast(spark.createDataFrame([(t,) for t in known], "token string")), "token").orderBy("token", F.desc("m"), "word").limit(TRAIN_PAIRS).collect()
        for token, n, word, m in mine:
            xs.append(pair_features(token, word, n, m))
            ys.append(int(truth.get(token) == word))
    words = sorted(hash_sample(vocab.where(F.col("token").rlike(r"^\p{L}{4,}$") & (F.col("n") >= SUPPORT)), ["token"], TRAIN_WORDS).collect())
    rng = random.Random(5)
    count = {w: n for w, n in words}
    for w, n in words:
        bad = _misread(w, rng)
        if bad and bad not in count and n >= RATIO:
            seen = math.exp(rng.random() * math.log(max(1.0, n / RATIO)))  # as often as a candidate may be seen
            xs.append(pair_features(bad, w, seen, n))
            ys.append(1)
            # a word that merely looks like this one at the same distance, as frequent as words are
            other = w[: len(w) // 2] + rng.choice("aeioudrt") + w[len(w) // 2 + 1 :]
            if shape_key(other) != shape_key(w):
                xs.append(pair_features(other, w, seen, n))
                ys.append(0)
    return Boosted.train(np.array(xs), np.array(ys)) if xs else Boosted(-8.0, [])


def corrections(vocab: DataFrame, blocks: DataFrame) -> DataFrame:
    """(token, word): the best correction of every token that is judged a misreading."""
    pairs = materialize(candidates(vocab), "pairs")
    ranker = train_ranker(blocks.where("source_kind = 'pdf'"), pairs, vocab)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for token, word, n, m in batches:
            x = [pair_features(*v) for v in zip(token, word, n, m)]
            yield pd.Series(ranker.probability(np.array(x)) if x else [], dtype="float64")

    best = pairs.select("token", F.struct(score("token", "word", "n", "m").alias("p"), F.col("m"), F.col("word")).alias("s")).groupBy("token").agg(F.max("s").alias("s"))
    return best.where("s.p >= 0.5").select("token", F.col("s.word").alias("word"))


def misread_words(told: DataFrame, fixes: DataFrame) -> DataFrame:
    """(place, record_id, token, word) of misread words in prose, broken ones put together, and their corrections."""
    tokens = told.select("place", "record_id", F.explode(F.array_distinct(F.concat("tokens", F.transform("breaks", lambda x: F.concat(x["left"], x["right"]))))).alias("token"))
    return lookup_join(tokens, fixes, ["token"], spread=["record_id"]).select("place", "record_id", "token", "word")


# ---- broken words -----------------------------------------------------------------------------------------------


_ROLES = ("joined", "compound", "left", "right", "first")


def break_features(mark: str, right: str, n: dict[str, float], left: str) -> list[float]:
    """What tells whether the mark between two fragments is part of the word; ``n`` has the counts by role."""
    lg = lambda k: math.log1p(n.get(k) or 0)
    return [lg("joined"), lg("compound"), lg("first"), lg("left"), lg("right"), float(mark == "-"), float(not right), lg("joined") - lg("compound"), len(left), len(right)]


def train_breaks(vocab: DataFrame) -> Boosted:
    """The line-pair classifier, from words and compounds broken on purpose."""
    frequent = lambda pattern: sorted(r[0] for r in hash_sample(vocab.where(F.col("token").rlike(pattern) & (F.col("n") >= SUPPORT)), ["token"], TRAIN_WORDS).collect())
    rng = random.Random(7)
    made: list[tuple[str, str, str, int]] = []
    for w in frequent(r"^\p{L}{5,}$"):
        k = rng.randint(2, len(w) - 2)
        mark = rng.choice(MARKS) if rng.random() < 0.4 else "-"
        made += [(w[:k], w[k:], mark, 1), (w[:k], "", mark, 1)]
        if rng.random() < 0.3:  # a broken word that is misread is in no vocabulary
            made.append((w[:k] + "\u0001", w[k:] + "\u0001", mark, 1))
    for c in frequent(r"^\p{L}+-\p{L}+$"):
        a, b = c.split("-")
        made += [(a, b, "-", 0), (a, "", "-", 0)]
    if not made:
        return Boosted(8.0, [])
    asked = sorted({t for left, right, _, _ in made for t in (left, right, left + right, f"{left}-{right}", left + "-") if t})
    rows = vocab.join(F.broadcast(vocab.sparkSession.createDataFrame([(t,) for t in asked], "token string")), "token").select("token", "n").collect()
    known = {r.token: float(r.n) for r in rows}
    xs = []
    for left, right, mark, _ in made:
        n = {"left": known.get(left), "first": known.get(left + "-")}
        if right:
            n |= {"joined": known.get(left + right), "compound": known.get(f"{left}-{right}"), "right": known.get(right)}
        xs.append(break_features(mark, right, n, left))
    return Boosted.train(np.array(xs), np.array([y for *_, y in made]))


def broken_words(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """(place, record_id, left, mark, right) of those breaks ``found`` in prose whose mark isn't part of the word."""
    found = materialize(found, "breaks")
    model = train_breaks(vocab)
    distinct = found.select("left", "mark", "right").distinct()
    keys = F.array(
        F.struct(F.lit("joined").alias("role"), F.when(F.col("right") != "", F.concat("left", "right")).alias("token")),
        F.struct(F.lit("compound").alias("role"), F.when(F.col("right") != "", F.concat_ws("-", "left", "right")).alias("token")),
        F.struct(F.lit("left").alias("role"), F.col("left").alias("token")),
        F.struct(F.lit("right").alias("role"), F.when(F.col("right") != "", F.col("right")).alias("token")),
        F.struct(F.lit("first").alias("role"), F.concat("left", F.lit("-")).alias("token")),
    )
    asked = distinct.select("left", "mark", "right", F.inline(keys))
    told = lookup_join(asked, vocab.select("token", "n"), ["token"], "left", spread=["left", "right"])
    wide = told.groupBy("left", "mark", "right").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in _ROLES])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = [break_features(r["mark"], r["right"], {k: r[f"n_{k}"] for k in _ROLES}, r["left"]) for r in pdf.to_dict("records")]
            yield pd.Series(model.probability(np.array(x)) if x else [], dtype="float64")

    bad = wide.where(score(F.struct("left", "mark", "right", *[f"n_{r}" for r in _ROLES])) >= 0.5).select("left", "mark", "right")
    return lookup_join(found, bad, ["left", "mark", "right"], spread=["record_id"]).select("place", "record_id", "left", "mark", "right").distinct()


def breaks_of(told: DataFrame) -> DataFrame:
    """(place, record_id, left, mark, right): one row per break."""
    return told.where(F.size("breaks") > 0).select("place", "record_id", F.inline("breaks"))


# ---- furniture --------------------------------------------------------------------------------------------------


def signature(line: Column) -> Column:
    """A short line without what changes from page to page: case, numbers (also misread or Roman), spacing."""
    low = F.regexp_replace(F.lower(F.trim(line)), r"[\s ]+", " ")
    roman = F.regexp_replace(low, r"^(\W*)(?=[ivxlc])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})(\W*)$", "$1#$2")
    number = F.regexp_replace(roman, r"(?<![\p{L}\p{N}])[\dlo|]*\d[\dlo|]*(?![\p{L}\p{N}])|(?<=[|\] ])l{1,2}$|^l{1,2}(?= )", "#")
    return F.regexp_replace(number, r"#( of #)", "#$1")


def short_lines(recs: DataFrame) -> DataFrame:
    """(place, record_id, document_id, page, line, at, band, signature): records of one short line, and first and last lines of visuals.

    ``at`` is ``whole`` for a record, ``first`` or ``last`` for a line of a visual of several lines.
    """
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = F.split(trimmed, "\n")
    whole = recs.where("place <> 'enrichment'").withColumn("line", trimmed).where((F.length("line") <= LONGEST) & ~F.col("line").contains("\n")).withColumn("at", F.lit("whole"))
    ends = recs.where("place = 'enrichment' and prose").withColumn("l", lines).where(F.size("l") > 1)
    ends = ends.select("*", F.explode(F.array(F.struct(F.lit("first").alias("at"), F.element_at("l", 1).alias("line")), F.struct(F.lit("last").alias("at"), F.element_at("l", -1).alias("line")))).alias("e"))
    ends = ends.select("place", "record_id", "document_id", "page", F.col("e.line").alias("line"), F.col("e.at").alias("at"), "band", "top", "low").where(F.length("line") <= LONGEST)
    cols = ["place", "record_id", "document_id", "page", "line", "at", "band", "top", "low"]
    return whole.select(*cols).unionByName(ends.select(*cols)).where(F.col("line").rlike(r"\S")).withColumn("signature", signature(F.col("line")))


#: Columns of a line's statistics, in the order :func:`line_features` takes them.
_PAIRED = ("pages", "margin", "body", "steady")


def line_features(line: str, page: float | None, pages: float, margin: float, body: float, steady: float, top: float | None = None, low: float | None = None) -> list[float]:
    """Form of a line, whether it carries its page's number, how it pairs with lines of its signature on other pages, and its place on the page."""
    text = line.strip()
    words = re.findall(r"[^\W\d_]+", text)
    numbers = [int(x) for x in re.findall(r"\d{1,6}", text)]
    bare = re.sub(r"^\W+|\W+$", "", text)
    roman = bool(bare) and bool(_ROMAN.match(bare)) and len(bare) <= 6
    own = float(page is not None and page == page and int(page) in numbers)
    edge = bool(re.match(r"^\d+\s{2,}\S|.*(?:\||\s{2,})\s*[\dl]+$", text))
    of = bool(re.match(r"(?i)^\W*(?:page|seite|página|p\.)?\s*\d+\s*(?:of|von|de|/)\s*\d+\W*$", text))
    box = [-1.0, -1.0] if top is None or top != top or low is None or low != low else [float(top), float(low)]
    return [
        float(not words or roman), float(roman), own, float(edge), float(of), len(words), float(text[-1:] in ".:;,!?"), float(text.isupper() and len(words) > 0),
        min(pages, 10), min(margin, 10), min(body, 10), float(steady), float(len(numbers) == 1 and len(str(numbers[0])) >= 4 and not words), len(text), float(bool(re.match(r"(?i)^(?:chapter|kapitel|capítulo|chapitre) \d", text))), *box,
    ]


def furniture_lines(recs: DataFrame) -> DataFrame:
    """(place, record_id, line) of running headers, footers and page numbers, whole records or lines of a visual."""
    lines = materialize(short_lines(recs), "lines")
    ahead = F.expr("try_cast(nullif(regexp_extract(line, '([0-9]{1,6})', 1), '') as int)") - F.col("page")
    stats = lines.where("at = 'whole'").groupBy("document_id", "signature").agg(
        F.countDistinct("page").alias("pages"), F.count(F.when(F.col("band") == 1, 1)).alias("margin"), F.count(F.when(F.col("band") == 0, 1)).alias("body"),
        F.coalesce((F.min(ahead) == F.max(ahead)) & (F.min("page") < F.max("page")), F.lit(False)).cast("int").alias("steady"),
    )
    known = lookup_join(lines, stats, ["document_id", "signature"], "left", spread=["record_id", "at"]).na.fill(0, list(_PAIRED))
    known = materialize(known, "known")
    rows = hash_sample(known.where("band is not null"), ["place", "record_id", "at", "line"], TRAIN_LINES).select("line", "page", *_PAIRED, "band", "top", "low").collect()
    rows.sort(key=str)
    xs, ys = [], []
    for r in rows:  # once with its box, and once as a line without one, of which its own box may not speak
        xs.append(line_features(r.line, r.page, r.pages, r.margin, r.body, r.steady, r.top, r.low))
        xs.append(line_features(r.line, r.page, r.pages, r.margin - (r.band == 1), r.body - (r.band == 0), r.steady))
        ys += [int(r.band == 1)] * 2
    model = Boosted.train(np.array(xs), np.array(ys)) if xs else Boosted(-8.0, [])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = [line_features(*v) for v in zip(*columns)]
            yield pd.Series(model.probability(np.array(x)) if x else [], dtype="float64")

    return known.where(score("line", "page", *_PAIRED, "top", "low") >= 0.5).select("place", "record_id", "line").distinct()


def furniture_records(recs: DataFrame) -> DataFrame:
    """(place, record_id) of records that are, and visuals that contain, furniture."""
    return furniture_lines(recs).select("place", "record_id").distinct()


# ---- together ---------------------------------------------------------------------------------------------------


def defects(page_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, record_id, defect): furniture, hyphen and glyph, one row each; a record that is furniture has no other."""
    recs = records(page_blocks, blocks)
    furniture = materialize(furniture_records(recs), "furniture")
    told = materialize(facts(recs), "facts")
    vocab = materialize(vocabulary(told), "vocabulary")
    fixes = corrections(vocab, blocks)
    broken = broken_words(breaks_of(told), vocab).select("place", "record_id", F.lit("hyphen").alias("defect"))
    words = broken.unionByName(misread_words(told, fixes).select("place", "record_id", F.lit("glyph").alias("defect"))).distinct()
    whole = furniture.where("place <> 'enrichment'")
    words = key_join(words, whole, ["place", "record_id"], "left_anti")
    return furniture.withColumn("defect", F.lit("furniture")).unionByName(words)


# ---- paragraphs over several records ----------------------------------------------------------------------------

#: Characters of a record's two ends that tell how it joins others (no word is longer), and pages or blocks in a range.
END, RANGE = 256, 64


def goes_on(tail: Column, head: Column, next_page: Column) -> Column:
    """Whether a record that begins with ``head`` goes on with the last word of one that ends with ``tail`` or, from the top of the ``next_page``, with its last sentence."""
    b = F.substring(head, 1, 1)
    cut = F.regexp_extract(tail, rf"({_LETTER})[{MARKS}]$", 1)
    word = b.rlike(_LETTER) & (~b.rlike(r"\p{Lu}") | cut.rlike(r"\p{Lu}"))
    sentence = next_page & ~tail.rlike(r"[.!?:;。！？][\"')\]»”’]*$") & b.rlike(r"\p{Ll}")
    return F.coalesce(F.when(cut != "", word).otherwise(sentence), F.lit(False))


def links(recs: DataFrame, furniture: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """(place, record_id, head_id, at, left, mark, right): body records of prose that a column, page or box cuts, and those that go on with them.

    All records of one paragraph have the ``head_id`` of the first and stand in the order of ``at``; where one goes on with a broken word, the
    break is given with it. Furniture, code and visuals in between don't part them; an OCR layer is read by itself. The order is that of the pages
    and boxes, left column first where a page has two. Only the ends of texts are sorted, in ranges of pages; what a range begins
    with is looked up in the range before.
    """
    body = F.col("prose") & F.col("spot").isNotNull() & F.coalesce(F.col("band") == 0, F.lit(True)) & F.col("document_id").isNotNull()
    ends = recs.where(body).select(
        "place", "record_id", "document_id", "page", "spot", F.substring(F.regexp_replace("text", r"^\s+", ""), 1, END).alias("head"), F.right(F.regexp_replace("text", r"\s+$", ""), F.lit(END)).alias("tail")
    )
    ends = key_join(ends, furniture.where("place <> 'enrichment'").select("place", "record_id").distinct(), ["place", "record_id"], "left_anti")
    two = page_columns(page_blocks).where("columns = 2").select(F.lit("page_block").alias("place"), "document_id", "page", F.lit(1.0).alias("two"))
    ends = key_join(ends, two, ["place", "document_id", "page"], "left")
    column = F.coalesce(F.col("spot.k1") * F.col("two"), F.lit(0.0))
    # ids are numbers in page blocks, and of one length in blocks
    at = F.struct(F.col("spot.k0").alias("k0"), column.alias("k1"), F.col("spot.k2").alias("k2"), F.col("spot.k3").alias("k3"), F.length("record_id").alias("size"), F.col("record_id").alias("id"))
    group = ["document_id", "place", "layer"]
    ends = ends.select(*group[:2], F.col("spot.layer").alias("layer"), "record_id", "page", "head", "tail", at.alias("at"), F.floor(F.col("spot.k0") / RANGE).alias("range")).distinct()
    ends = materialize(ends, "ends")

    part = W.partitionBy(*group, "range").orderBy("at")
    ranges = W.partitionBy(*group).orderBy("range")
    last = ends.groupBy(*group, "range").agg(F.max_by(F.struct("tail", "page"), "at").alias("end"))
    last = last.select(*group, "range", F.lag("end").over(ranges).alias("seam"))
    rows = key_join(ends, last, [*group, "range"])
    before = F.coalesce(F.lag(F.struct("tail", "page")).over(part), F.col("seam"))
    rows = rows.withColumn("before", before).withColumn("on", goes_on(F.col("before.tail"), F.col("head"), F.coalesce(F.col("page") == F.col("before.page") + 1, F.lit(False))))
    rows = rows.withColumn("own", F.last(F.when(~F.col("on"), F.struct("record_id", "at")), ignorenulls=True).over(part.rowsBetween(W.unboundedPreceding, 0)))
    rows = materialize(rows.select(*group, "range", "record_id", "at", "on", "own", "before.tail", "head"), "joins")
    carried = rows.groupBy(*group, "range").agg(F.max_by("own", "at").alias("end"))
    carried = carried.select(*group, "range", F.last("end", ignorenulls=True).over(ranges.rowsBetween(W.unboundedPreceding, -1)).alias("seam"))
    followers = key_join(rows.where("on"), carried, [*group, "range"]).withColumn("first", F.coalesce("own", "seam"))
    pair = rf"({_LETTER}+)([{MARKS}])$"
    right = F.lower(F.regexp_extract("head", rf"^({_LETTER}+)", 1))
    found = followers.select(
        "place", "record_id", F.col("first.record_id").alias("head_id"), "at", F.lower(F.regexp_extract("tail", pair, 1)).alias("left"), F.regexp_extract("tail", pair, 2).alias("mark"), right.alias("right")
    )
    heads = followers.select("place", F.col("first.record_id").alias("record_id"), F.col("first.record_id").alias("head_id"), F.col("first.at").alias("at"), *[F.lit("").alias(c) for c in ("left", "mark", "right")])
    return found.unionByName(heads.distinct())


# ---- repair -----------------------------------------------------------------------------------------------------


def repair_text(text: str, prose: bool, furniture: list[str], broken: list[tuple[str, str, str]], fixes: dict[str, str]) -> str:
    """One record as continuous paragraphs: furniture gone, broken words joined, misread ones corrected, lines of a paragraph joined."""
    lines = text.split("\n")
    for edge in (0, -1):
        if furniture and lines and lines[edge].strip() in {f.strip() for f in furniture}:
            lines.pop(edge)
    text = "\n".join(lines)
    if not prose:
        return text
    for left, mark, right in broken:
        if right:
            text = re.sub(rf"(?i)({re.escape(left)}){re.escape(mark)}[ \t]*\n\s*({re.escape(right)})", r"\1\2", text)
    if fixes:

        def put(m: re.Match) -> str:
            old = m.group()
            new, seen = old.lower(), 0
            while new in fixes and seen < 3:  # a correction may itself be one letter off
                new, seen = fixes[new], seen + 1
            return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new

        text = re.sub(r"[^\W_]*[^\W_@|]*(?:[^\W_]|[@|])+", lambda m: put(m) if m.group().lower() in fixes else m.group(), text)
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text) if p.strip())


def repaired(page_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, record_id, text): every PDF text repaired; records that are furniture, or that went on with an earlier one and stand there, are left out."""
    recs = records(page_blocks, blocks)
    furniture = materialize(furniture_lines(recs), "furniture")
    told = materialize(facts(recs), "facts")
    vocab = materialize(vocabulary(told), "vocabulary")
    chains = materialize(links(recs, furniture, page_blocks), "links")
    heads = chains.select("place", "record_id", "head_id").distinct()

    across = chains.where("left <> '' and right <> ''").select("place", F.col("head_id").alias("record_id"), "left", "mark", "right")
    crossing = across.select("place", "record_id", F.array(F.concat("left", "right")).alias("tokens"), F.array().cast("array<string>").alias("compounds"), F.array().cast("array<struct<left:string,mark:string,right:string>>").alias("breaks"))
    words = misread_words(told.unionByName(crossing), corrections(vocab, blocks))
    broken = broken_words(breaks_of(told).where("right <> ''").unionByName(across), vocab)
    none = F.lit("")
    notes = (
        furniture.select("place", "record_id", F.lit("line").alias("kind"), F.col("line").alias("a"), none.alias("b"), none.alias("c"))
        .unionByName(broken.select("place", "record_id", F.lit("break").alias("kind"), F.col("left").alias("a"), F.col("mark").alias("b"), F.col("right").alias("c")))
        .unionByName(words.select("place", "record_id", F.lit("word").alias("kind"), F.col("token").alias("a"), F.col("word").alias("b"), none.alias("c")))
    )
    # what is noted of a part is noted of its paragraph
    notes = key_join(notes, heads, ["place", "record_id"], "left").select("place", F.coalesce("head_id", "record_id").alias("record_id"), F.struct("kind", "a", "b", "c").alias("note"))
    notes = notes.groupBy("place", "record_id").agg(F.sort_array(F.collect_set("note")).alias("notes"))
    order = chains.groupBy("place", "record_id").agg(F.min("head_id").alias("head_id"), F.min("at").alias("at"))
    known = order.join(notes.hint("merge"), ["place", "record_id"], "full").select("place", "record_id", "head_id", "at", "notes")

    @F.pandas_udf("string")
    def repair(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, prose, notes in batches:
            out = []
            for t, p, n in zip(text, prose, notes):
                n = [] if n is None else list(n)
                out.append(
                    repair_text(t, bool(p), [x["a"] for x in n if x["kind"] == "line"], [(x["a"], x["b"], x["c"]) for x in n if x["kind"] == "break"], {x["a"]: x["b"] for x in n if x["kind"] == "word"})
                )
            yield pd.Series(out, dtype=object)

    joined = key_join(recs.select("place", "record_id", "text", "prose"), known, ["place", "record_id"], "left")
    alone = joined.where("head_id is null").select("place", "record_id", "text", "prose", "notes").distinct()  # by the join's own partitions
    parts = joined.where("head_id is not null").groupBy("place", F.col("head_id").alias("record_id")).agg(
        F.array_sort(F.collect_set(F.struct("at", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")))).alias("parts"), F.max("prose").alias("prose"), F.max("notes").alias("notes")
    )
    chained = parts.select("place", "record_id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"), "prose", "notes")
    return alone.unionByName(chained).select("place", "record_id", repair("text", "prose", "notes").alias("text")).where("text <> ''")
