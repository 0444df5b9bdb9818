"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a session names another in this setting. Every executor must have it.
FOLDER_SETTING = "spark.branchloom.tokenizers"
DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def folder(spark: SparkSession) -> str:
    return spark.conf.get(FOLDER_SETTING, DEFAULT_FOLDER)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; 0 for null and empty ones. Strings of special tokens are ordinary text."""
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_count(text: Column, spark: SparkSession, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column, by an Arrow-batched function over whole texts."""
    path = os.path.join(folder(spark), vocabulary)

    @F.pandas_udf("int")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_tokens([t if isinstance(t, str) else None for t in s], path), dtype="int32")

    return n(text)
