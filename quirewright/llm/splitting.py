"""Splitting oversized documents at natural boundaries (problem 10).

Method: the text is tokenized once; prefix sums of the tokens' byte lengths give the place of every
token boundary, and the natural ones form sorted arrays (paragraph, line, sentence, word). For each piece the last
boundary under the limit is found by binary search, the strongest kind first as long as it leaves the
piece at least half full; the next piece begins ``overlap`` tokens before the end. Where the
overlap leaves no room for any boundary it is shortened; only where a run without any boundary alone
exceeds the limit is the text cut hard, at a token boundary that is also a character boundary.

Pieces are slices of the original text: dropping each piece's first ``overlap_chars`` characters and
concatenating gives the document back. A piece never exceeds the limit when it is tokenized alone; where the
tokenizer joins differently at a cut the piece is shortened until it fits.

Scale: a map over documents, no shuffle. One document is one task's work, in memory proportional to its length.

Cases: NULL and blank texts and documents within the limit give one piece (NULL text: none); a limit of 1 and an
overlap of the limit or more are brought down so that every piece makes progress.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.llm.tokens import DEFAULT, encoding

SCHEMA = "doc_id long, piece int, text string, start_char int, end_char int, n_tokens int, overlap_chars int, cut string"
#: Kinds of natural boundary, strongest first; a stronger one is taken if it fills at least this share of the limit.
KINDS = (("paragraph", 0.5), ("line", 0.5), ("sentence", 0.5), ("word", 0.0))
# Sentence-ending punctuation and its full-width forms.
_ENDS = ".!?。．！？｡"
_RUN = regex.compile(rf"[^\s{regex.escape(_ENDS)}]+")
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_END_CODES = np.array([ord(c) for c in _ENDS], np.uint32)


def boundaries(text: str) -> dict[str, np.ndarray]:
    """Character positions at which a cut is natural, by kind, sorted."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space, stop, line = np.isin(code, _SPACES), np.isin(code, _END_CODES), code == 10
    before, after = slice(None, -1), slice(1, None)  # position p lies between character p-1 and p
    edge = np.zeros(len(code), bool)
    edge[:-2] = line[1:-1] & line[2:]
    paragraph = line[before] & np.concatenate([[False], line[:-2]]) | edge[:-1]
    at = lambda mask: np.flatnonzero(mask).astype(np.int64) + 1
    return {
        "paragraph": at(paragraph),
        "line": at(line[before] | line[after]),
        "sentence": at(stop[before] & space[after]),
        "word": at(space[before] | space[after] | stop[before]),
    }


def has_unbreakable_run(text: str, limit: int, enc) -> bool:
    """Whether a run without whitespace and sentence-ending punctuation alone exceeds the limit."""
    return any(len(m.group()) * 4 > limit and len(enc.encode_ordinary(m.group())) > limit for m in _RUN.finditer(text))


def token_ends(text: str, tokens: list[int], enc) -> np.ndarray:
    """Character position of the end of each token, -1 where it is inside a character."""
    sizes = np.fromiter((len(b) for b in enc.decode_tokens_bytes(tokens)), np.int64, len(tokens))
    ends = np.cumsum(sizes)
    if text.isascii():
        return ends
    raw = np.frombuffer(text.encode(), np.uint8)
    lead = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    at = chars[ends].astype(np.int64)
    inside = np.ones(len(ends), bool)
    inside[ends < len(raw)] = lead[ends[ends < len(raw)]]
    at[~inside] = -1
    return at


def _last(a: np.ndarray, low: int, high: int) -> int | None:
    """The last element of a sorted array in (low, high]."""
    i = int(np.searchsorted(a, high, side="right")) - 1
    return int(a[i]) if i >= 0 and a[i] > low else None


def split_text(text: str, limit: int, overlap: int, enc) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, overlap_chars, cut) of each piece of a text."""
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= limit:
        return [(0, len(text), len(tokens), 0, "end")]
    overlap = min(overlap, limit - 1)
    ends = token_ends(text, tokens, enc)
    whole = ends[ends >= 0]  # only token ends that are character ends, strictly increasing
    count = np.flatnonzero(ends >= 0) + 1
    kinds = boundaries(text)
    out, start, done = [], 0, 0

    def used(upto: int) -> int:
        """Tokens of the document before a character position, rounded down."""
        i = int(np.searchsorted(whole, upto, side="right")) - 1
        return int(count[i]) if i >= 0 else 0

    def reach(frm: int, n: int) -> int:
        """Last character position at most ``n`` tokens after ``frm``."""
        i = int(np.searchsorted(count, used(frm) + n, side="right")) - 1
        return int(whole[i]) if i >= 0 else 0

    while done < len(text):
        high = reach(start, limit)
        if high >= len(text) and len(enc.encode_ordinary(text[start:])) <= limit:
            out.append((start, len(text), len(enc.encode_ordinary(text[start:])), done - start, "end"))
            break
        cut = end = None
        for kind, fill in KINDS:
            low = max(done, reach(start, int(limit * fill)) if fill else done)
            end = _last(kinds[kind], low, min(high, len(text) - 1))
            if end is not None:
                cut = kind
                break
        if end is None:
            if start < done:  # the overlap takes the room: shorten it
                start = max(done, start + 1) if high <= done else min(done, _next(kinds["word"], start, done))
                continue
            end, cut = high, "hard"
            if end <= done:
                later = whole[whole > done]
                end = int(later[0]) if len(later) else len(text)
        n = len(enc.encode_ordinary(text[start:end]))
        shrink = limit
        while n > limit and shrink > 1:  # the tokenizer joins differently at the cut
            shrink -= max(1, n - limit)
            high = reach(start, max(1, shrink))
            e = _last(kinds["word"], done, high)
            if e is None:
                if start < done:
                    break
                e, cut = max(high, done + 1), "hard"
            elif cut != "hard":
                cut = "word" if e not in (end,) else cut
            end = e
            n = len(enc.encode_ordinary(text[start:end]))
        if n > limit and start < done:
            start = min(done, _next(kinds["word"], start, done))
            continue
        out.append((start, end, n, done - start, cut))
        done = end
        start = _back(text, start, end, overlap, used, reach, enc)
    return out


def _next(a: np.ndarray, after: int, upto: int) -> int:
    """The first boundary after a position, at most ``upto``."""
    i = int(np.searchsorted(a, after, side="right"))
    return int(a[i]) if i < len(a) and a[i] < upto else upto


def _back(text: str, start: int, end: int, overlap: int, used, reach, enc) -> int:
    """The place ``overlap`` tokens before ``end``, after ``start``."""
    if not overlap:
        return end
    at = reach(0, max(0, used(end) - overlap)) if used(end) > overlap else 0
    while at < end and len(enc.encode_ordinary(text[at:end])) > overlap:
        at += 1
    return min(end, max(at, start + 1))


def _pieces(limit: int, overlap: int, path: str, texts: bool):
    import pandas as pd

    names = ["doc_id", "piece", "text", "start_char", "end_char", "n_tokens", "overlap_chars", "cut"]

    def run(batches):
        enc = encoding(path)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for i, (a, b, n, o, cut) in enumerate(split_text(text, limit, overlap, enc)):
                    rows.append((doc, i, text[a:b] if texts else None, a, b, n, o, cut))
            yield pd.DataFrame(rows, columns=names).astype({"piece": "int32", "start_char": "int32", "end_char": "int32", "n_tokens": "int32", "overlap_chars": "int32"})

    return run


def split_documents(documents: DataFrame, limit: int, overlap: int, path: str = DEFAULT, texts: bool = True) -> DataFrame:
    """One row per piece of each document, in order; ``cut`` tells how the piece ends (paragraph, line, sentence, word, hard, end)."""
    docs = documents.where("text is not null").select("doc_id", "text")
    return docs.mapInPandas(_pieces(limit, overlap, path, texts), SCHEMA)


def _forced(limit: int, overlap: int, path: str):
    def run(batches):
        enc = encoding(path)
        for pdf in batches:
            hard = [
                any(c == "hard" for *_, c in split_text(t, limit, overlap, enc)) and has_unbreakable_run(t, limit, enc) for t in pdf["text"]
            ]
            yield pdf.loc[hard, ["doc_id"]]

    return run


def unsplittable(documents: DataFrame, limit: int, overlap: int, path: str = DEFAULT) -> DataFrame:
    """(doc_id) of documents that the splitter had to cut hard, confirmed by a run that alone exceeds the limit."""
    docs = documents.where("text is not null").select("doc_id", "text")
    return docs.mapInPandas(_forced(limit, overlap, path), "doc_id long").distinct()
