"""Token counts of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = 1 << 16  # characters encoded at once
# Fixed value: the pattern that splits text into words for the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(path: str):
    """The encoding of a rank file, loaded once in a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; long texts are cut at blanks into pieces, so that time and memory grow in proportion."""
    if not text:
        return 0
    enc, n, at = encoding(path), 0, 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            blank = text.rfind(" ", at + 1, end)
            end = blank if blank > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Add the number of tokens as a long; null and empty texts have 0.

    The driver sends the tokenizer's file to the executors, so they need no copy of it.
    """
    df.sparkSession.sparkContext.addFile(path)
    name = Path(path).name

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([count_tokens(t, SparkFiles.get(name)) for t in part], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
