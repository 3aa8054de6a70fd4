"""Vectorized rolling and positional hashes over many texts at once (numpy on the Arrow buffers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


#: Random 64-bit words per byte value: one table for boundaries, one for identities, one for histograms.
GEAR, IDENTITY, BAG = _splitmix(1, 256), _splitmix(2, 256), _splitmix(3, 256)
#: Odd multiplier of the positional hash.
STEP = np.uint64(0x9FB21C651E98DF25)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, a zero byte after each text, and the start of each text (and the end of all)."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    out = np.zeros(int(starts[-1]), np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(np.arange(len(raw)), lengths)] = data
    return out, starts


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Gear hash of the ``window`` bytes up to each position."""
    g = GEAR[data]
    h = np.zeros(len(data), np.uint64)
    for j in range(window):
        h[j:] += g[: len(g) - j] << np.uint64(j)
    return h


def segment_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positional 64-bit hash of each segment ``data[starts[i]:starts[i+1]]``; no segment is empty."""
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    lengths = np.diff(starts)
    powers = np.ones(int(lengths.max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, STEP, np.uint64), out=powers[1:]) if len(powers) > 1 else None
    at = np.arange(len(data)) - np.repeat(starts[:-1], lengths)
    return np.add.reduceat(IDENTITY[data] * powers[at], starts[:-1]).view(np.int64)


#: Takes the place of a line without letters in texts given to ``chunked``.
NO_LINE = "\x01"


def chunked(texts: pa.Array, window: int = 8, mean: int = 32) -> tuple[pa.Array, pa.Array]:
    """Content-defined chunks of each text, and its lines with the chunks that lie wholly inside them.

    A chunk ends where the rolling hash of the last ``window`` bytes meets a condition that holds once in ``mean`` positions, and at
    the end of the text. Line ends are bytes like any other. Boundaries whose window lies inside a line depend on that line only, so
    a chunk between two of them is the same wherever the line stands. The first result lists the hashes of all chunks, the second
    structs of a line's number (from 1), the hash of the line and the hashes of the chunks inside it; ``NO_LINE`` is left out.
    """
    data, starts = packed(texts)
    kind = pa.list_(pa.struct([("no", pa.int32()), ("line", pa.int64()), ("inside", pa.list_(pa.int64()))]))
    if len(texts) == 0:
        return pa.array([], pa.list_(pa.int64())), pa.array([], kind)
    cut = (rolling(data, window) >> np.uint64(window)) % np.uint64(mean) == 0
    near = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts)) < window - 1
    cut[near] = False
    cut[starts[1:] - 1] = True
    ends = np.flatnonzero(cut)
    hashes = segment_hashes(data, np.concatenate([[0], ends + 1]))
    chunks = pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, starts, side="left"), pa.int32()), pa.array(hashes))

    stop = np.flatnonzero((data == 10) | (data == 0))  # the end of each line, that of the text included
    first = np.concatenate([[0], stop[:-1] + 1])
    value = IDENTITY[data]
    value[stop] = 0
    at = np.arange(len(data)) - np.repeat(first, stop + 1 - first)
    powers = np.ones(int((stop + 1 - first).max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, STEP, np.uint64), out=powers[1:])
    line = np.add.reduceat(value * powers[at], first).view(np.int64)
    text = np.searchsorted(starts, first, side="right") - 1
    head = np.searchsorted(first, starts[:-1], side="left")
    number = np.arange(len(first)) - head[text] + 1
    kept = ~((stop - first == 1) & (data[first] == 1))
    # chunks inside a line: those that begin after its first own boundary and end before the line does
    low = np.searchsorted(ends, first + window - 1, side="left") + 1
    high = np.maximum(low, np.searchsorted(ends, stop, side="left"))
    low, high = low[kept], high[kept]
    size = high - low
    offsets = np.concatenate([[0], np.cumsum(size)])
    which = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low, size)
    inside = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[which]))
    rows = pa.StructArray.from_arrays([pa.array(number[kept], pa.int32()), pa.array(line[kept]), inside], fields=list(kind.value_type))
    return chunks, pa.ListArray.from_arrays(pa.array(np.searchsorted(text[kept], np.arange(len(texts) + 1), side="left"), pa.int32()), rows)
