"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the rank file of the tokenizer lies on every executor; a parameter of all that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of the whole text; 0 for a null or empty one."""

    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, LongType())(text)
