"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published pre-tokenisation of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *keep, n_tokens) of every row; a null text has 0 tokens. Whole texts, one pass, no shuffle."""
    cols = [F.col(key).alias("_key"), *[F.col(c).alias(c) for c in keep], F.col(text).alias("_text")]
    d = docs.select(*cols)
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            pdf["n_tokens"] = [len(encode(t)) if isinstance(t, str) and t else 0 for t in pdf["_text"].tolist()]
            yield pdf.drop(columns="_text")

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["_key", *keep]) + ", n_tokens bigint"
    return d.mapInPandas(run, schema).withColumnRenamed("_key", key)
