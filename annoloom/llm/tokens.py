"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter, never part of this repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    """The path in ANNOLOOM_VOCABULARY, else that of the installed public byte-level vocabulary."""
    path = os.environ.get("ANNOLOOM_VOCABULARY")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of the whole text, strings of special tokens as ordinary text; 0 for null."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(count(F.coalesce(text, F.lit(""))))
