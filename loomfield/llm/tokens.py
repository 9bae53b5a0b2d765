"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

#: Where the vocabulary lies on every executor. A parameter of all operators here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """A tiktoken encoder for a rank file, once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text, encoded as a whole; 0 for null."""
    if not text:
        return 0
    return len(encoder(path).encode_ordinary(text))


def counted(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and each row's token count. One pass; null texts count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [count(t if isinstance(t, str) else None, path) for t in batch["_text"]]
            yield batch.drop(columns="_text").assign(**{out: pd.Series(numbers, dtype="int64", index=batch.index)})

    given = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(given).mapInPandas(run, f"{schema}, `{out}` bigint")
