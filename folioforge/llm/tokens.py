"""Lengths of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: a fixed value of byte-level BPE vocabularies: where texts are split before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """One encoder for each process."""
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(docs: DataFrame, columns: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``columns`` and n_tokens of each document; a null text has none. The longest texts are encoded whole."""
    fields = [f"{c} {t}" for c, t in docs.select(*columns).dtypes]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder).encode_ordinary
        for batch in batches:
            batch["n_tokens"] = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield batch[[*columns, "n_tokens"]]

    wanted = list(dict.fromkeys([*columns, "text"]))
    return docs.select(*wanted).mapInPandas(count, ", ".join([*fields, "n_tokens long"]))


def uniform(column: str, seed: int = 0):
    """A number in (0, 1) for each value, the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
