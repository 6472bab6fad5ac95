"""Embedding: an embedder interface, and metrics of vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.vectors import dot, is_bad, norm

PAIRWISE_FIRST = 50


class Unreachable(Exception):
    """No connection, or an answer that trying again won't change."""


class TryAgain(Exception):
    """A timeout or a server error."""


class Embedder(Protocol):
    def embed_batch(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """A stand-in without a model: words are hashed to signed dimensions, the sum is normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_batch(self, texts: Sequence[str]) -> list[list[float] | None]:
        import hashlib
        import math

        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else v)
        return out


class Down:
    """An embedder whose service is out, to see what an outage does."""

    def embed_batch(self, texts: Sequence[str]) -> list[list[float] | None]:
        raise Unreachable("no connection")


def embed_with_retries(embedder: Embedder, texts: list[str], retries: int = 2, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> list[list[float] | None]:
    """A batch, tried again with doubled waits; given up, it is halved down to single texts, which are None.
    `Unreachable` is raised at once."""
    for attempt in range(retries + 1):
        try:
            out = embedder.embed_batch(texts)
            if len(out) != len(texts):
                raise Unreachable(f"{len(out)} vectors for {len(texts)} texts")
            return out
        except TryAgain:
            if attempt < retries:
                sleep(wait * 2**attempt)
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return [x for part in (texts[:half], texts[half:]) for x in embed_with_retries(embedder, part, retries, wait, sleep)]


def embed(chunks: DataFrame, make: Callable[[], Embedder], text_col: str = "chunk_text", batch: int = 32) -> DataFrame:
    """Adds `embedding`; the embedder is made once for each task."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in series:
            these = texts.fillna("").tolist()
            vectors = [v for a in range(0, len(these), batch) for v in embed_with_retries(embedder, these[a : a + batch])]
            yield pd.Series(vectors, dtype=object)

    return chunks.withColumn("embedding", run(text_col))


def embed_metrics(vectors: DataFrame, group: str, dim: int) -> DataFrame:
    """By group: expected, embedded and failed vectors, mean and population deviation of the norms, score."""
    good = ~is_bad(F.col("embedding"), dim)
    n = F.when(good, norm(F.col("embedding")))
    return vectors.groupBy(group).agg(
        F.count("*").alias("expected"), F.count_if(good).alias("embedded"), F.count_if(~good).alias("failed"), F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"),
        F.round(F.count_if(good) * 100.0 / F.count("*"), 2).alias("embed_score"),
    )


def mean_pairwise_cosine(vectors: DataFrame, group: str, order: str, dim: int, first: int = PAIRWISE_FIRST, threshold: float = 0.98) -> DataFrame:
    """Mean cosine of the pairs among a group's first good vectors, and whether it is suspiciously high.

    With unit vectors u the sum over pairs is (|sum u|^2 - n) / 2, so no pair is made: the components are
    summed by position."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    unit = F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))
    those = vectors.where(~is_bad(F.col("embedding"), dim)).withColumn("__n", place).where(F.col("__n") <= first).select(group, unit.alias("u"))
    sums = those.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    mean = F.when(F.max("n") >= 2, (F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).otherwise(0.0)
    return sums.groupBy(group).agg(F.max("n").alias("vectors"), mean.alias("mean_cosine")).withColumn("anomaly", F.col("mean_cosine") > threshold)


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors without a chunk."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def length_of(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("squared", dot(F.col("embedding"), F.col("embedding")))
