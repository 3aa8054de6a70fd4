"""Repetition inside a single document (problem 6).

Method: logistic regression on hashed word and character n-grams, trained on labelled quality rows,
calibrated, scored in Arrow batches against the fixed threshold ``THRESHOLD``. The hashed features are an n-gram's
kind together with its occurrence number in the record (first, second, third or fourth, later) and its
hash, weighted by characters; so the model sees how much of a record is n-grams met before, and whether
certain phrases (boiled-over templates) tell more. Labels come from the exact measure over a sample of at
most ``train_rows`` records. The calibrated probability decides which records are repetitive; for those an exact check of the share follows.

The share itself is measured exactly for every record: characters of words that lie in a word trigram (or, in text without spaces, a character 12-gram)
that stood in the record before, all occurrences beyond the first counted, of all non-space characters.

Scale: a map over records in Arrow batches, no shuffle of text; training is bounded. A record is measured in
time proportional to its length.

Cases: NULL, empty and blank texts have share 0 and probability 0; with no labelled rows, or one class only, every other probability is 1, so the
exact check alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import hash_sample

#: Hashed dimensions, and bound on labelled rows.
DIMENSIONS = 1 << 12
TRAIN_ROWS = 4000
MIN_SHARE = 0.4
#: A record is repetitive from this probability on.
THRESHOLD = 0.5
_GRAM, _CHARS = 3, 12
#: Characters in a character n-gram of the features, and the odd multiplier of their hash.
_SPAN, _ODD = 24, 0x9E3779B97F4A7C15
_POWERS = [pow(_ODD, k, 1 << 64) for k in range(_SPAN)]


def _units(text: str) -> tuple[list[str], int]:
    """The record as units and the n-gram size: words, or characters where words are too long to be words."""
    words = text.split()
    if not words:
        return [], _GRAM
    if max(map(len, words)) > 200 or sum(map(len, words)) / len(words) > 25:
        return [c for c in text if not c.isspace()], _CHARS
    return words, _GRAM


def repeated_share(text: str | None) -> float:
    """Share of a record's characters that repeat what stood in it before."""
    if not text:
        return 0.0
    units, n = _units(text)
    if not units:
        return 0.0
    total = sum(map(len, units))
    if len(units) <= n:
        seen, again = set(), 0
        for u in units:
            again += len(u) if u in seen else 0
            seen.add(u)
        return again / total
    seen, covered, upto = set(), 0, 0
    sizes = list(map(len, units))
    for i in range(len(units) - n + 1):
        g = tuple(units[i : i + n])
        if g in seen:
            lo = max(upto, i)
            covered += sum(sizes[lo : i + n])
            upto = i + n
        else:
            seen.add(g)
    return covered / total


def _slot(kind: str, k: int) -> int:
    """Feature of an n-gram's kind and occurrence number."""
    return crc32(f"{kind}{min(k, 4)}".encode()) % 64


_CHAR_SLOTS = np.array([_slot("c", k) for k in range(5)])


def features(text: str) -> dict[int, float]:
    """Hashed n-gram features of a record, normalized by its length; a record of no more units than an n-gram has counts by its units, as in the exact share."""
    units, n = _units(text)
    n = n if len(units) > n else 1
    out: dict[int, float] = {}
    if not units:
        return out
    total = sum(map(len, units))
    count: dict = {}
    for i in range(len(units) - n + 1):
        g = tuple(units[i : i + n])
        k = count[g] = count.get(g, 0) + 1
        if k > 1:
            w = len(units[i]) / total
            a = _slot("w", k)
            out[a] = out.get(a, 0.0) + w
            b = 64 + crc32(" ".join(g).encode("utf-8", "ignore")) % (DIMENSIONS - 64)
            out[b] = out.get(b, 0.0) + w * 0.1
    if len(text) <= _SPAN:
        return out
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(code) - _SPAN + 1
    h = np.zeros(m, np.uint64)
    for j, p in enumerate(_POWERS):
        h += code[j : j + m] * np.uint64(p)
    order = np.argsort(h, kind="stable")
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    at = np.arange(m)
    nth = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    again = nth > 1
    slots = np.bincount(_CHAR_SLOTS[np.minimum(nth[again], 4)], minlength=64) / m
    for k in np.flatnonzero(slots):
        out[int(k)] = out.get(int(k), 0.0) + float(slots[k])
    own, times = np.unique(64 + (h[order][again] >> np.uint64(32)) % np.uint64(DIMENSIONS - 64), return_counts=True)
    for k, c in zip(own.tolist(), times.tolist()):
        out[k] = out.get(k, 0.0) + 0.1 * c / m
    return out


class Quality:
    """Logistic regression over sparse hashed features with Platt calibration."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    @classmethod
    def train(cls, texts: list[str], labels: list[bool], rounds: int = 300) -> Quality:
        y = np.array(labels, float)
        if len(y) < 8 or y.min() == y.max():
            return cls()
        rows, cols, vals = [], [], []
        for i, t in enumerate(texts):
            for k, v in features(t).items():
                rows.append(i)
                cols.append(k)
                vals.append(v)
        r, c, v = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals)
        w, b, g2 = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS + 1, 1e-8)
        held = np.arange(len(y)) % 4 == 3
        weight = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())))
        for _ in range(rounds):
            z = np.bincount(r, w[c] * v, len(y)) + b
            d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(c, d[r] * v, DIMENSIONS) + 1e-5 * w
            g2[:-1] += grad**2
            g2[-1] += d.sum() ** 2
            w -= 0.5 * grad / np.sqrt(g2[:-1])
            b -= 0.5 * d.sum() / np.sqrt(g2[-1])
        z = np.bincount(r, w[c] * v, len(y)) + b
        s, t = 1.0, 0.0
        zh, yh = (z[held], y[held]) if held.any() and 0 < y[held].sum() < held.sum() else (z, y)
        for _ in range(400):  # Platt scaling on the rows held out
            p = 1 / (1 + np.exp(-np.clip(s * zh + t, -30, 30)))
            s -= 0.5 * float(((p - yh) * zh).mean()) / (1 + float((zh**2).mean()))
            t -= 0.5 * float((p - yh).mean())
        return cls(w, b, max(s, 0.05), t)

    def probability(self, text: str) -> float:
        """Calibrated probability that the record is repetitive; 1 without a trained model."""
        if self.weights is None:
            return 1.0
        z = self.bias + sum(self.weights[k] * v for k, v in features(text).items())
        return float(1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))))


def records(blocks: DataFrame, vlm_results: DataFrame) -> DataFrame:
    """(place, document_id, block_id, text) of all records; the entries of visible_text are lines."""
    a = blocks.where("enrichment.raw_text is not null").select(F.lit("raw_text").alias("place"), "document_id", "block_id", F.col("enrichment.raw_text").alias("text"))
    b = vlm_results.where("visible_text is not null").select(F.lit("visible_text").alias("place"), "document_id", "block_id", F.array_join("visible_text", "\n", "").alias("text"))
    return a.unionByName(b)


def train(recs: DataFrame, min_share: float = MIN_SHARE, train_rows: int = TRAIN_ROWS) -> Quality:
    """A model from at most ``train_rows`` records, labelled by the exact measure."""
    some = hash_sample(recs.where("length(text) > 0"), ["place", "document_id", "block_id", "text"], train_rows)
    texts = sorted(r[0] for r in some.select("text").collect())
    return Quality.train(texts, [repeated_share(t) >= min_share for t in texts])


def repetition(recs: DataFrame, model: Quality) -> DataFrame:
    """``recs`` without their text, with ``probability`` and the exact ``share``, both 0 for empty texts."""

    @F.pandas_udf("probability double, share double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame({"probability": [model.probability(t) if t and t.strip() else 0.0 for t in s], "share": [repeated_share(t) for t in s]}, dtype="float64")

    scored = recs.withColumn("__s", score("text"))
    return scored.select("place", "document_id", "block_id", "__s.probability", "__s.share")


def shares(recs: DataFrame) -> DataFrame:
    """(place, document_id, block_id, share): the exact share of every record."""

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([repeated_share(t) for t in s], dtype="float64")

    return recs.select("place", "document_id", "block_id", share("text").alias("share"))


def repetitive(blocks: DataFrame, vlm_results: DataFrame, min_share: float = MIN_SHARE, threshold: float = THRESHOLD) -> DataFrame:
    """(place, document_id, block_id) of records that the model takes for repetitive, and of which at least ``min_share`` repeats what stood in them before."""
    recs = records(blocks, vlm_results)
    model = train(recs, min_share)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([bool(t and t.strip()) and model.probability(t) >= threshold and repeated_share(t) >= min_share for t in s], dtype=bool)

    return recs.where(found("text")).select("place", "document_id", "block_id").distinct()
