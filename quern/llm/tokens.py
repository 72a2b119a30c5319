"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file that every executor can reach."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; null and empty texts have none."""

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
