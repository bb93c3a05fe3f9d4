"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in stretches of about this many characters.
STRETCH = 50_000
#: A letter or digit before something else: the pattern ends a match there, whatever stands before and after.
_END = re.compile(r"[^\W_](?=[\W_])")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The encoder, built once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, least: int = STRETCH) -> Iterator[str]:
    """The whole text in pieces of at least ``least`` characters that end where a match of the pattern ends.

    So the pieces have the tokens of the uncut text; a text without such an end stays whole.
    """
    start = 0
    while len(text) - start > least and (end := _END.search(text, start + least)):
        yield text[start : end.end()]
        start = end.end()
    yield text[start:]


def n_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    encode = encoding(vocabulary).encode_ordinary
    return sum(len(encode(s)) for s in stretches(text))


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([n_tokens(t, vocabulary) if t else 0 for t in batch], dtype="int64")

    return count(text)


def sized(df: DataFrame, text: str, size: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the column ``size``."""
    return df.withColumn(size, token_count(F.col(f"`{text}`"), vocabulary))
