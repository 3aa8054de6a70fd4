"""Sizes and tokens by a public tokenizer. The vocabulary file is a parameter; it is never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of public tokenizer files and the file used where nothing else is told.
TOKENIZERS = os.environ.get("QUIREWRIGHT_TOKENIZERS", "/opt/tokenizers")
DEFAULT = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT):
    """The tokenizer of a rank file, once per process. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = DEFAULT) -> Column:
    """Number of tokens of a text; 0 for NULL and empty texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield s.map(lambda x: len(enc.encode_ordinary(x)) if x else 0).astype("int32")

    return count(text)


def limit_of(limits: DataFrame, name: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a named limit; the table of limits is a few rows by nature."""
    rows = limits.where(F.col("limit_name") == name).select("max_tokens", "overlap_tokens").limit(1).collect()
    if not rows or not rows[0][0] or rows[0][0] < 1:
        raise ValueError(f"no limit {name!r}")
    return int(rows[0][0]), max(0, int(rows[0][1] or 0))
