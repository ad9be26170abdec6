"""Paragraph vectors: encoder surface, default encoder and cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """L2-normalised term frequencies: a token's place is the first 32 bits of its md5 modulo ``dim``."""

    class Places(dict):
        def __missing__(self, token: str) -> int:
            if len(self) > 1_000_000:  # a bound on memory, not on the tokens
                self.clear()
            at = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            return at

    def build() -> Callable[[list[str]], np.ndarray]:
        places = Places()

        def encode(texts: list[str]) -> np.ndarray:
            tokens = [text.lower().split() for text in texts]
            sizes = np.fromiter(map(len, tokens), np.int64, len(texts))
            at = np.fromiter(map(places.__getitem__, chain.from_iterable(tokens)), np.int64, sizes.sum())
            row = np.repeat(np.arange(len(texts)), sizes)
            out = np.bincount(row * dim + at, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float64)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)

        return encode

    build.name = f"hashing-{dim}"
    return build


def embed(df: DataFrame, encoder: Encoder, text: str = "paragraph", vec: str = "vec") -> DataFrame:
    """Add a float vector of ``text``, null for a null text. The encoder is built once per task, called batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(encode(texts.tolist()), dtype=np.float32)))

    return df.withColumn(vec, F.when(F.col(text).isNotNull(), run(F.coalesce(text, F.lit("")))))


def cache_key(df: DataFrame, text: str = "paragraph") -> DataFrame:
    return df.withColumn("text_key", F.md5(F.col(text)))


def missing_embeddings(df: DataFrame, cache: DataFrame, text: str = "paragraph", buckets: int | None = None) -> DataFrame:
    """``text_key, text`` of the distinct texts that the cache does not hold.

    Of a cache in ``buckets`` by key nothing is moved: the texts are dealt like it.
    """
    wanted = cache_key(df, text).where(F.col(text).isNotNull()).groupBy("text_key").agg(F.first(text).alias(text))
    if buckets:
        # an outer join, as the planner would move an anti-join in front of the texts' exchange
        held = cache.select("text_key", F.lit(True).alias("held"))
        dealt = wanted.repartition(buckets, "text_key").join(held, "text_key", "left")
        return dealt.where("held IS NULL").drop("held")
    return wanted.join(cache.select("text_key"), "text_key", "left_anti")
