"""Embeddings by a provider that is plugged in: texts whose vector is missing or of another model are embedded in batches."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider:
    """UDF-EmbeddingProvider: what a back end gives: its name, its model, the dimension, and a vector for each text of a batch.
    It is sent to tasks, so connections are opened in `embed`, not before."""

    provider, model, dimension = "base", "base", 1_536

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class HashProvider(EmbeddingProvider):
    """A local provider for tests: unit vectors of the bytes of each text's SHA-256, repeated to the dimension."""

    provider, model = "mock", "mock-embedding-v0"

    def __init__(self, dimension: int = EmbeddingProvider.dimension):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            raw = [b / 255.0 for b in itertools.islice(itertools.cycle(hashlib.sha256(text.encode()).digest()), self.dimension)]
            size = sum(x * x for x in raw) ** 0.5 or 1.0
            out.append([x / size for x in raw])
        return out


def embed_stale(chunks: DataFrame, stored: DataFrame, provider: EmbeddingProvider, batch: int = 64) -> DataFrame:
    """chunk_id, embedding, embedding_provider, embedding_model and fresh of every chunk (chunk_id, text): the stored vector where
    it is of the provider and model, else a new one. Only stale texts reach Python, `batch` at a time; a null text is empty."""
    kept = ["embedding", "embedding_provider", "embedding_model"]
    rows = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).join(stored.select("chunk_id", *kept), "chunk_id", "left")
    good = F.col("embedding").isNotNull() & F.col("embedding_provider").eqNullSafe(F.lit(provider.provider)) & F.col("embedding_model").eqNullSafe(F.lit(provider.model))
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in provider.embed(texts[at : at + batch])]
            yield pd.DataFrame({"chunk_id": rows["chunk_id"], "embedding": vectors})

    new = rows.where(~good).select("chunk_id", "text").mapInPandas(embed, f"chunk_id {kind}, embedding array<double>")
    new = new.select("*", F.lit(provider.provider).alias("embedding_provider"), F.lit(provider.model).alias("embedding_model"), F.lit(True).alias("fresh"))
    return rows.where(good).select("chunk_id", *kept, F.lit(False).alias("fresh")).unionByName(new)
