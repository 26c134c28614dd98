"""Token sizes under a public byte-level BPE vocabulary; nothing is trained here."""

from __future__ import annotations

import base64
import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The splitting pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the installed public vocabulary if none is given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _worker_cache() -> dict:
    # Kernels travel by value and get fresh globals in each task; a module in sys.modules lives as long as the worker.
    return sys.modules.setdefault("_loomrec_worker_cache", types.ModuleType("_loomrec_worker_cache")).__dict__


def encoder(path: str | None = None):
    """The tiktoken encoding of a vocabulary file, kept for the life of the worker process."""
    cache = _worker_cache()
    key = ("encoder", path)
    if key not in cache:
        import tiktoken

        with open(vocabulary_path(path), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        cache[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def count_tokens(texts, path: str | None = None) -> np.ndarray:
    """Number of tokens of each text; a null text has none.  Strings of special tokens count as ordinary text."""
    encode = encoder(path).encode_ordinary
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), dtype=np.int64, count=len(texts))


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Column expression with the token count of a text column (Arrow batches, whole texts)."""
    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), path))

    return tokens(text)
