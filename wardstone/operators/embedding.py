"""Vectors of texts: one model for each worker process, each text of a batch encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list]

_LOADED: dict[str, Any] = {}


def loaded(name: str, load: Callable[[], Embedder]) -> Embedder:
    """The embedder of this name, loaded at its first use in a worker process and kept for the process's life."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def with_embeddings(df: DataFrame, load: Callable[[], Embedder], name: str, text: str = "text", out: str = "embedding", size: int = 256) -> DataFrame:
    """df with a vector for each text, null for a null text.

    load gives the embedder; name says which model and version it is, as processes keep models by
    name over tasks and queries. The distinct texts of an Arrow batch are encoded, at most `size` in a
    call, so repeated texts that lie near each other (sort by text to bring them together) cost one encoding.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes, distinct = pd.factorize(texts)  # nulls have the code -1
            vectors: list = []
            for i in range(0, len(distinct), size):
                vectors.extend(loaded(name, load)(list(distinct[i : i + size])))
            yield pd.Series([None if c < 0 else vectors[c] for c in codes], dtype="object")

    return df.withColumn(out, F.pandas_udf(embed, "array<float>")(F.col(text)))
