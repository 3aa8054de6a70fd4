"""Mixing sources to target weights (problem 9).

Method: pivotal dependent rounding. Every document of a source has the same fractional number of
copies (the source's quota over its tokens, capped by its ``max_repeats``); the whole part is taken for
certain, the fractions are paired and mass moves at random from one to the other until one of them is
0 or 1. Documents are paired in order of size, so that the tokens, and not only the number of
documents, come out close to the quota. Each bucket of a source leaves one undecided document; these
are combined in a reduction tree of fixed fan-in until one is left, which is drawn.

Quotas: the total defaults to the tokens that the target sources hold. A source that cannot give its
share within its cap gives what it can, and the shortfall goes to the others in proportion to their
targets; a target source without documents gives nothing. Actual shares are reported beside the targets.

Scale: the driver sees one row per target source. Buckets are hashed parts of a source of bounded size, so
a source with a third of all rows is many tasks; the tree has log(buckets) levels.

Cases: NULL and blank texts have 0 tokens and are taken like the rest of their source; documents of sources without a target
are not returned; draws depend on ``seed`` and doc_id only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirewright.cluster import materialize
from quirewright.llm.tokens import DEFAULT, token_count

#: Documents in a bucket, and undecided ones that meet in a node of the tree.
BUCKET_ROWS, FAN_IN = 20_000, 64
#: The table of targets has at most so many sources.
MAX_SOURCES = 10_000


def quotas(shares: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to take from each source: target shares of ``total``, no more than ``repeats`` times what there is, shortfall shared out."""
    live = {s for s in shares if tokens.get(s, 0) > 0 and shares[s] > 0 and repeats.get(s, 1) > 0}
    total = float(sum(tokens[s] for s in live)) if total is None else float(total)
    out: dict[str, float] = {s: 0.0 for s in shares}
    open_, left = set(live), total
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= repeats[s] * tokens[s]}
        if not full:
            for s in open_:
                out[s] = left * shares[s] / weight
            break
        for s in full:
            out[s] = float(repeats[s] * tokens[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities by pairwise transfers in the given order; the index of the one left undecided, or -1."""
    p = p.copy()
    at = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if at < 0:
            at = j
            continue
        a, b = p[at], p[j]
        u = draws[j]
        if a + b <= 1:
            if u < b / (a + b):
                p[at], p[j] = 0.0, a + b
            else:
                p[at], p[j] = a + b, 0.0
        elif u < (1 - b) / (2 - a - b):
            p[at], p[j] = 1.0, a + b - 1
        else:
            p[at], p[j] = a + b - 1, 1.0
        first, second = 1e-12 < p[at] < 1 - 1e-12, 1e-12 < p[j] < 1 - 1e-12
        at = at if first else j if second else -1
        for i in (at, j):
            if i >= 0 and not 1e-12 < p[i] < 1 - 1e-12:
                p[i] = round(p[i])
    return p, at


def _round(seed: int, last: bool):
    """Grouped map: decide all documents of a node but one (all, in the last round)."""

    def run(pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id"], kind="stable")
        ids = pdf["doc_id"].to_numpy()
        rng = np.random.default_rng([seed, *(int(x) & 0xFFFFFFFF for x in (ids[0], ids[-1], len(ids)))])
        p, at = pivotal(pdf["p"].to_numpy(float), rng.random(len(pdf)))
        done = np.ones(len(pdf), bool)
        if at >= 0:
            if last:
                p[at] = float(rng.random() < p[at])
            else:
                done[at] = False
        return pdf.assign(p=p, done=done)

    return run


def copies(documents: DataFrame, targets: DataFrame, path: str = DEFAULT, total: float | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document of a target source is taken, 0 included."""
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the table of targets")
    shares = {r[0]: float(r[1] or 0) for r in rows}
    repeats = {r[0]: int(r[2] if r[2] is not None else 1) for r in rows}
    docs = documents.where(F.col("source").isin(list(shares)) & F.col("doc_id").isNotNull())
    sized = materialize(docs.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens")), "sized")
    held = {r[0]: (int(r[1] or 0), int(r[2])) for r in sized.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    quota = quotas(shares, {s: t for s, (t, _) in held.items()}, repeats, total)
    each = {s: min(quota[s] / t, repeats[s]) if t else 0.0 for s, (t, _) in held.items()}
    if not each:
        return sized.withColumn("copies", F.lit(0))
    ratio = F.element_at(F.create_map(*[F.lit(x) for s, r in each.items() for x in (s, r)]), F.col("source"))
    buckets = max(1, max(math.ceil(n / BUCKET_ROWS) for _, n in held.values()))
    work = sized.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    work = work.withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn("done", F.lit(False))
    schema = "doc_id long, source string, n_tokens int, whole long, p double, node int, done boolean"
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    decided = None
    work = work.select(*fields)
    while True:
        last = buckets == 1
        step = materialize(work.groupBy("source", "node").applyInPandas(_round(seed, last), schema), "pivot")
        part = step if last else step.where("done")
        decided = part if decided is None else decided.unionByName(part)
        if last:
            break
        buckets = math.ceil(buckets / FAN_IN)
        work = step.where("not done").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int") if buckets > 1 else F.lit(0))
    return decided.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p")).cast("int").alias("copies"))


def shares_reached(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: target_share, max_repeats, documents, tokens held and taken, most copies, actual_share."""
    by = taken.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens").cast("long")).alias("tokens_held"),
        F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("tokens_taken"), F.max("copies").alias("most_copies"),
    )
    joined = targets.select("source", "target_share", "max_repeats").join(F.broadcast(by), "source", "left")
    filled = joined.na.fill(0, ["documents", "tokens_held", "tokens_taken", "most_copies"])
    # a window over the whole table: it has one row per target source
    whole = F.sum("tokens_taken").over(W.partitionBy(F.lit(1)))
    return filled.withColumn("actual_share", F.when(whole > 0, F.col("tokens_taken") / whole).otherwise(0.0))
