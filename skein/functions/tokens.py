"""Counting tokens with a public byte-level BPE vocabulary, as a column."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import token_estimate

# Fixed value: the split of this family of vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens; 0 for empty and null texts. path: a file of pieces in base64
    and their ranks, which every executor can read. Without that file, or without an encoder, the estimate counts."""
    try:
        _encoding(path)
    except (OSError, ImportError):
        return token_estimate

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return lambda text: count(F.coalesce(text, F.lit("")))
