"""Visually identical text with different characters (problem 2).

Method: a weighted edit automaton walks a trie of the vocabulary's own spellings. Taking a character for one that looks alike
and passing over an ignorable one cost nothing, every other edit costs one; what costs more than ``max_cost`` is cut off. With
``max_cost`` 0, which production uses because words that differ in any other way don't look the same, a token is matched if some vocabulary token looks the same. It
then gets that token's canonical spelling: of the spellings that look the same the vocabulary's most frequent, not the table's. Tokens
that match nothing are normalized by the character table. As tokens that look the same meet the same trie entries, or none, equal
looks always get one form, and different ones different forms. ASCII tokens are looked up as well where the vocabulary has a
spelling in another script that looks like ASCII.

Canonical form: NFC; full-width, font and ligature variants resolved; ignorable characters dropped;
every kind of space made U+0020 (tabs and line breaks stay); look-alike letters as the vocabulary spells the word, else in the script of the
rest of their word, else Latin. Superscripts, fractions, circled and vulgar forms look different and stay.

Scale: a map over the texts in Arrow batches. The vocabulary is an aggregate over all rows of the reference table (a
curated set: its distinct tokens with a character beyond ASCII are what is sent to the workers).
Matching texts to samples is an equi-join on the canonical form.

Cases: NULL stays NULL, empty stays empty; of equally frequent spellings the one with more ASCII, then the smallest, is canonical.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import lookup_join

# Letters of other scripts that look like a Latin letter, Latin first.
CYRILLIC = {
    "a": "а", "c": "с", "e": "е", "h": "һ", "i": "і", "j": "ј", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ",
    "T": "Т", "W": "Ԝ", "X": "Х", "Y": "Ү", "d": "ԁ", "l": "ӏ",
}
GREEK = {
    "o": "ο", "v": "ν", "i": "ι", "u": "υ", "p": "ρ", "y": "γ",
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ",
}
OTHER = {"o": "օ", "h": "հ", "n": "ո", "u": "ս", "g": "ɡ", "a": "ɑ", "i": "ı", "l": "ǀ"}
# Punctuation with one look.
PUNCTUATION = {"‐": "-", "‑": "-", "˗": "-", "․": ".", "‥": "..", "…": "...", ";": ";", " ": " ", "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "꞉": ":"}

_TO_LATIN = {v: k for script in (CYRILLIC, GREEK, OTHER) for k, v in script.items()}
_SCRIPTS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK}
_RESOLVED = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>"}


def ignorable(c: str) -> bool:
    """Whether a character shows nothing: format controls, variation selectors, fillers."""
    o = ord(c)
    return (unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x605) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def _table(c: str) -> str:
    """The decomposed plain form of one character, look-alikes of other scripts not yet folded."""
    if c in "\t\n\r" or c < "\x7f":
        return c
    if ignorable(c):
        return ""
    if c in PUNCTUATION:
        return PUNCTUATION[c]
    if unicodedata.category(c) == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d:
        kind, *codes = d.split() if d[0] == "<" else ("", *d.split())
        if kind in _RESOLVED or not kind:
            if kind == "<compat>" and codes and codes[0] == "0020":  # a spacing accent
                return c
            return "".join(_table(chr(int(x, 16))) for x in codes)
    return c


class Plain(dict):
    """``str.translate`` table that fills itself."""

    def __missing__(self, o: int) -> str:
        r = self[o] = _table(chr(o))
        return r


PLAIN = Plain()


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() and c not in _TO_LATIN else ""


def fold_word(word: str) -> str:
    """Look-alike letters of one decomposed word in one script: that of its letters that belong to no other."""
    for name, own in _SCRIPTS.items():
        if any(_script(c) == name for c in word):
            back = {**{k: v for k, v in own.items()}, **{o: own[lat] for o, lat in _TO_LATIN.items() if lat in own}}
            return "".join(back.get(c, c) for c in word)
    return "".join(_TO_LATIN.get(c, c) for c in word)


def skeleton(token: str) -> str:
    """Decomposed plain form of a token: equal for tokens that look the same."""
    return fold_word(unicodedata.normalize("NFD", token.translate(PLAIN)))


def spelling(token: str) -> str:
    """A token's own spelling in plain characters: composed forms, ligatures and widths resolved, ignorables gone, letters in their own script."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token.translate(PLAIN)))


class Trie:
    """Trie of vocabulary spellings, in decomposed plain characters of their own script; a terminal holds spelling and count."""

    __slots__ = ("root", "n", "ambiguous")

    def __init__(self, tokens: Iterable[str | tuple[str, int]] = ()):
        self.root: dict = {}
        self.n = 0
        #: Spellings beyond ASCII that look like ASCII.
        self.ambiguous: set[str] = set()
        for t in tokens:
            self.add(*((t, 1) if isinstance(t, str) else t))

    def add(self, token: str, count: int = 1) -> None:
        """Add occurrences of a spelling; one that mixes scripts is no spelling of its word, and counts as the table's."""
        own = spelling(token)
        if len({unicodedata.name(c, "").split(" ")[0] for c in own if c.isalpha()} & {"LATIN", "CYRILLIC", "GREEK"}) > 1:
            own = unicodedata.normalize("NFC", skeleton(own))
        plain = unicodedata.normalize("NFD", own)
        node = self.root
        for c in plain:
            node = node.setdefault(c, {})
        self.n += "" not in node
        node[""] = (own, node.get("", (own, 0))[1] + count)
        if not own.isascii() and all(_TO_LATIN.get(c, c).isascii() for c in plain):
            self.ambiguous.add(own)

    @property
    def foreign(self) -> bool:
        """Whether a canonical spelling beyond ASCII looks like ASCII, so that ASCII tokens must be looked up."""
        return any(not self.match(w)[0].isascii() for w in self.ambiguous)

    @staticmethod
    def cost(c: str, d: str) -> int:
        """Cost of taking one plain character for another: none for look-alikes."""
        return int(_TO_LATIN.get(c, c) != _TO_LATIN.get(d, d))

    def match(self, token: str, max_cost: int = 0) -> tuple[str, int] | None:
        """Canonical spelling and cost of the cheapest vocabulary token within ``max_cost``; of equally cheap ones the most frequent, then the most ASCII, then the smallest.

        The automaton's states are (place in the token, node) with the least cost to reach them; each step passes a character
        of the token (free if ignorable), of the vocabulary, or one of each.
        """
        chars = unicodedata.normalize("NFD", "".join(PLAIN[ord(c)] for c in token))
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}
        for c in (*chars, ""):
            if max_cost:  # characters of the vocabulary that the token lacks
                queue = list(states.values())
                while queue:
                    node, k = queue.pop()
                    if k < max_cost:
                        for d, child in node.items():
                            if d != "" and states.get(id(child), (child, max_cost + 1))[1] > k + 1:
                                states[id(child)] = (child, k + 1)
                                queue.append((child, k + 1))
            if c == "":
                break
            after: dict[int, tuple[dict, int]] = {}
            for node, k in states.values():
                if k < max_cost and after.get(id(node), (node, max_cost + 1))[1] > k + 1:
                    after[id(node)] = (node, k + 1)
                for d, child in node.items():
                    if d == "":
                        continue
                    new = k + self.cost(c, d)
                    if new <= max_cost and after.get(id(child), (child, max_cost + 1))[1] > new:
                        after[id(child)] = (child, new)
            if not after:
                return None
            states = after
        ends = [(k, -node[""][1], sum(not x.isascii() for x in node[""][0]), node[""][0]) for node, k in states.values() if "" in node]
        return (min(ends)[3], min(ends)[0]) if ends else None


def canonical_text(text: str, trie: Trie | None = None, cache: dict | None = None) -> str:
    """One text in canonical form."""
    foreign = trie is not None and trie.foreign
    if text.isascii() and not foreign:
        return text
    cache = {} if cache is None else cache
    out = []
    plain = unicodedata.normalize("NFD", text.translate(PLAIN))
    start = 0
    for i in range(len(plain) + 1):
        if i == len(plain) or plain[i] in " \t\n\r":
            word = plain[start:i]
            if word and (foreign or not word.isascii()):
                got = cache.get(word)
                if got is None:
                    hit = trie.match(word) if trie else None
                    got = hit[0] if hit else unicodedata.normalize("NFC", fold_word(word))
                    if len(cache) < 200_000:
                        cache[word] = got
                word = got
            out.append(word)
            if i < len(plain):
                out.append(plain[i])
            start = i + 1
    return "".join(out)


def vocabulary(reference: DataFrame, column: str) -> list[tuple[str, int]]:
    """(token, count): the distinct tokens beyond ASCII of all rows of a reference column, and the ASCII tokens that look like one of them."""

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [w for w in (spelling(x) for x in t.translate(PLAIN).split()) if w])

    @F.pandas_udf("string")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFC", skeleton(t)))

    found = reference.where(F.col(column).isNotNull()).select(F.explode(words(F.col(column))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("look", look("token"))
    beyond = found.where(F.col("token").rlike(r"[^\x00-\x7e]"))
    alike = found.join(beyond.select("look").distinct().hint("merge"), "look", "left_semi")
    return sorted((r.token, int(r.n)) for r in alike.select("token", "n").collect())


def canonical(column: Column, tokens: list[tuple[str, int]] | None = None) -> Column:
    """Column expression: the canonical form of a text column, with an optional vocabulary."""
    words = tokens or []

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, cache = Trie(words), {}
        for s in batches:
            yield s.map(lambda x: None if x is None else canonical_text(x, trie, cache))

    return run(column)


def same_looking(blocks: DataFrame, golden: DataFrame) -> DataFrame:
    """(document_id, block_id, sample_id): visual blocks whose selected text looks like a sample's but differs in characters."""
    tokens = vocabulary(golden, "gold_verbatim")
    samples = golden.where("gold_verbatim is not null").select("sample_id", "gold_verbatim", canonical(F.col("gold_verbatim"), tokens).alias("look"))
    texts = blocks.where("type = 'visual' and enrichment.selected_text is not null").select("document_id", "block_id", F.col("enrichment.selected_text").alias("text"))
    looks = texts.withColumn("look", canonical(F.col("text"), tokens))
    if not Trie(tokens).foreign:  # ASCII is canonical then, and never leaves the JVM
        ascii_only = ~F.col("text").rlike(r"[^\x00-\x7e]")
        looks = texts.where(ascii_only).withColumn("look", F.col("text")).unionByName(looks.where(~ascii_only))
    hits = lookup_join(looks, samples, ["look"], spread=["document_id", "block_id"])
    return hits.where("text <> gold_verbatim").select("document_id", "block_id", "sample_id").distinct()


def canonical_tables(blocks: DataFrame, golden: DataFrame) -> DataFrame:
    """(place, record_id, text): selected_text and gold_verbatim of all rows in canonical form."""
    tokens = vocabulary(golden, "gold_verbatim")
    a = blocks.where("enrichment.selected_text is not null").select(F.lit("selected_text").alias("place"), F.concat_ws("/", "document_id", "block_id").alias("record_id"), canonical(F.col("enrichment.selected_text"), tokens).alias("text"))
    b = golden.where("gold_verbatim is not null").select(F.lit("gold_verbatim").alias("place"), F.col("sample_id").alias("record_id"), canonical(F.col("gold_verbatim"), tokens).alias("text"))
    return a.unionByName(b).distinct()
