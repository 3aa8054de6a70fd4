"""Filling fixed-capacity containers with documents (problem 8).

Method: the configuration linear program over the length histogram. Its variables are patterns
(multisets of lengths that fit a container), its constraints the number of items of each length. It is solved by multiplicative
weights: a length's price starts at its size, the dual of the space bound, and falls exponentially with the share of its items covered; a
bounded knapsack dynamic program prices the best pattern over a bundle of lengths drawn at random, so that the patterns of one round are
disjoint; a pattern is used until its scarcest length is covered to ``STEP``, and rounds go on until every length is. The solution is rounded
down and the program solved again on what is left, until less than ``LEAST`` of the containers, or no full pattern, remains;
that rest is packed best-fit decreasing.

Only an item larger than a container is split, into full containers and a rest.

Scale: the driver sees the histogram, at most ``capacity`` numbers whatever the data; patterns and rounds are bounded by
the capacity as well. Documents are numbered within their length by bucketed counts (no task sorts a whole length), and
each finds its container by binary search in the plan.

Cases: NULL and blank texts have size 0 and lie, at no cost, in the containers in turn; a table without
any token has one container if it has documents; ties are broken by doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.cluster import dense_rank_in_groups, materialize
from quirewright.llm.tokens import DEFAULT, token_count

#: Lengths priced together, share of its scarcest length's items that a pattern may cover at a time, times the program is solved, share of the containers left to best fit.
BUNDLE, STEP, PHASES, LEAST = 64, 0.5, 16, 0.01
#: A token in a long item is at first worth up to so much more than in a short one, so that short items stay to fill gaps.
LONG_FIRST = 1.0
#: How fast the price of a length falls as its items are covered.
LAG = 2.0
#: Unused share of a container that a rounded pattern may have, more with each phase.
SLACK = 0.0005


def knapsack(value: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of greatest value: length -> count, at most ``most`` of a length, sizes summing to capacity at most.

    Counts are put together from powers of two, so the bound holds in the program itself.
    """
    items = []
    for n in np.flatnonzero((value > 0) & (most > 0))[::-1].tolist():
        k, size = min(int(most[n]), capacity // n), 1
        while k > 0:
            m = min(size, k)
            items.append((n, m))
            k -= m
            size *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for i, (n, m) in enumerate(items):
        gain = best[: capacity + 1 - n * m] + value[n] * m
        better = gain > best[n * m :] + 1e-9
        taken[i, n * m :] = better
        best[n * m :] = np.where(better, gain, best[n * m :])
    out: dict[int, int] = {}
    room = capacity
    for i in range(len(items) - 1, -1, -1):
        if taken[i, room]:
            n, m = items[i]
            out[n] = out.get(n, 0) + m
            room -= n * m
    return out


def relaxed(need: np.ndarray, rng: np.random.Generator, bundle: int = BUNDLE) -> dict[tuple, float]:
    """Pattern -> containers: a solution of the linear program that covers every item of the histogram ``need``, by multiplicative weights."""
    capacity = len(need) - 1
    size = np.arange(capacity + 1)
    price = size * (1 + LONG_FIRST * size / capacity)
    covered = np.zeros(capacity + 1)
    uses: dict[tuple, float] = {}
    while True:
        open_ = np.flatnonzero((need > 0) & (covered < 1))
        if not len(open_):
            return uses
        rng.shuffle(open_)
        for group in np.array_split(open_, max(1, len(open_) // bundle)):
            value = np.zeros(capacity + 1)
            value[group] = price[group] * np.exp(-LAG * covered[group])
            pattern = knapsack(value, need, capacity)
            key = tuple(sorted(pattern.items()))
            x = max(1.0, STEP * min(need[n] / k for n, k in key))
            uses[key] = uses.get(key, 0.0) + x
            for n, k in key:
                covered[n] += k * x / need[n]


def configurations(histogram: np.ndarray, bundle: int = BUNDLE, seed: int = 1) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(pattern, containers) that hold every item of a histogram (index = length, 0 unused), and how many of these entries, the first ones, are the program's."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    size = np.arange(capacity + 1)
    rng = np.random.default_rng(seed)
    plan: list[tuple[dict[int, int], int]] = []
    total = float((left * size).sum()) / capacity
    for phase in range(1, PHASES + 1):
        if float((left * size).sum()) / capacity < max(1.0, LEAST * total):
            break
        solution = relaxed(left.copy(), rng, bundle)
        filled = {key: sum(n * k for n, k in key) for key in solution}
        for key in sorted(solution, key=lambda t: (-filled[t], -solution[t], t)):
            m = int(min([solution[key], *(left[n] // k for n, k in key)]))
            if m > 0 and filled[key] >= capacity * (1 - SLACK * phase):
                plan.append((dict(key), m))
                for n, k in key:
                    left[n] -= k * m
    return plan + best_fit(left), len(plan)


def best_fit(left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: every pattern is used as often as it can be at once."""
    left, capacity, out = left.copy(), len(left) - 1, []
    while True:
        rest = np.flatnonzero(left)
        if not len(rest):
            return out
        pattern: dict[int, int] = {}
        room = capacity
        while room > 0:
            fit = rest[: int(np.searchsorted(rest, room, side="right"))]
            fit = fit[[left[n] > pattern.get(int(n), 0) for n in fit]] if len(fit) else fit
            if not len(fit):
                break
            n = int(fit[-1])
            k = int(min(room // n, left[n] - pattern.get(n, 0)))
            pattern[n] = pattern.get(n, 0) + k
            room -= n * k
        m = int(min(left[n] // k for n, k in pattern.items()))
        out.append((pattern, m))
        for n, k in pattern.items():
            left[n] -= k * m


def _ranges(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: starts of ranks, and of each range the first container, items a container, offset and slot of the first."""
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    base = 0
    for pattern, m in plan:
        offset = slot = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            own = rows.setdefault(n, [])
            start = own[-1][0] + own[-1][5] if own else 0
            own.append((start, base, k, offset, slot, k * m))  # type: ignore[arg-type]
            offset += n * k
            slot += k
        base += m
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def items_of(documents: DataFrame, capacity: int, path: str = DEFAULT) -> DataFrame:
    """(doc_id, piece, n_tokens): a document, or the pieces of one larger than a container."""
    sizes = documents.where("doc_id is not null").select("doc_id", token_count(F.col("text"), path).alias("size"))
    full = F.floor(F.col("size") / capacity).cast("int")
    pieces = F.when(F.col("size") <= capacity, F.array("size")).otherwise(
        F.concat(F.array_repeat(F.lit(capacity), full), F.when(F.col("size") % capacity > 0, F.array(F.col("size") % capacity)).otherwise(F.array().cast("array<int>")))
    )
    return sizes.select("doc_id", F.posexplode(pieces).alias("piece", "n_tokens"))


def pack(documents: DataFrame, capacity: int, path: str = DEFAULT) -> DataFrame:
    """(doc_id, piece, n_tokens, container, slot, offset, planned): where each document, or piece of an oversized one, lies.

    ``planned`` tells whether the linear program made the container, or best fit of the rest.
    """
    items = materialize(items_of(documents, capacity, path), "items")
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in items.groupBy("n_tokens").count().collect():  # at most capacity + 1 rows
        histogram[n] = c
    plan, programmed = configurations(histogram)
    containers = max(1, sum(m for _, m in plan))
    by_program = sum(m for _, m in plan[:programmed])
    where = _ranges(plan)

    def place(batches):
        for pdf in batches:
            n, rank = pdf["n_tokens"].to_numpy(), pdf["rank"].to_numpy()
            box, slot, offset = rank % containers, 1_000_000 + rank // containers, np.zeros(len(pdf), np.int64)
            for length in np.unique(n[n > 0]):
                mine = np.flatnonzero(n == length)
                start, base, k, off, first, _ = where[int(length)]
                i = np.searchsorted(start, rank[mine], side="right") - 1
                at = rank[mine] - start[i]
                box[mine] = base[i] + at // k[i]
                slot[mine] = first[i] + at % k[i]
                offset[mine] = off[i] + at % k[i] * length
            yield pdf.drop(columns="rank").assign(container=box, slot=slot, offset=offset, planned=box < by_program)

    ranked = dense_rank_in_groups(items, "n_tokens", ["doc_id", "piece"], "rank").select("doc_id", "piece", "n_tokens", "rank")
    return ranked.mapInPandas(place, "doc_id long, piece int, n_tokens int, container long, slot long, offset long, planned boolean")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, those by the linear program, items, tokens, the fullest container, the least that could do and the share of unused space."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"), F.max(F.col("planned").cast("int")).alias("planned"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("planned"), F.lit(0)).alias("planned_containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"), F.ceil(F.sum("used") / capacity).alias("least_containers"), (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
