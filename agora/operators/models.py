"""Text models on executors: loaded once by each worker, asked in batches, pooled over tokens, with ways that stand in for one that fails."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators.search import Embedder


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the tokens that mask has, (texts, tokens, dim) to (texts, dim); a text without tokens gets zeros."""
    m = mask[:, :, None].astype(float)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


class Pooled:
    """An embedder from a tokeniser, texts and a greatest length to (ids, mask), and a model, (ids, mask) to hidden states."""

    def __init__(self, model: str, dim: int, tokenise: Callable[[Sequence[str], int], tuple[np.ndarray, np.ndarray]], forward: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int = 8192, normalise: bool = True):
        self.model, self.dim, self.tokenise, self.forward, self.length, self.normalise = model, dim, tokenise, forward, length, normalise

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        ids, mask = self.tokenise(texts, self.length)
        out = mean_pool(self.forward(ids, mask), mask)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if self.normalise else out


class Fallback:
    """The first of several ways to one model that can be made; one that fails on a batch is given up for the next, which asks again.

    All ways must name the same model, as vectors of two are never compared; the last one's error raises."""

    def __init__(self, makers: Sequence[Callable[[], Embedder]]):
        self.left, self.now = list(makers), None
        self._next(ValueError("no way to a model"))

    def _next(self, error: Exception) -> None:
        while self.left:
            try:
                way = self.left.pop(0)()
            except Exception as e:  # whatever keeps one way from being made, the next may work
                error = e
                continue
            if self.now is not None and way.model != self.now.model:
                raise ValueError(f"{way.model} can't stand in for {self.now.model}")
            self.now, self.model, self.dim = way, way.model, way.dim
            return
        raise error

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        while True:
            try:
                return self.now(texts)
            except Exception as e:  # a remote way may fail at any time
                self._next(e)


def embed_batches(rows: DataFrame, source: str, makers: Sequence[Callable[[], Embedder]], model: str, size: int = 8, target: str = "embedding") -> DataFrame:
    """rows with the vectors of a text column, size texts at a time, and model; null counts as empty. Each worker makes its own
    embedder, once; one of another model raises."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        embedder = Fallback(makers)
        if embedder.model != model:
            raise ValueError(f"{embedder.model} in place of {model}")
        return lambda texts: np.asarray(embedder([str(t) for t in texts]), np.float32)

    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=size)
    return rows.withColumn(target, run(F.coalesce(F.col(source), F.lit("")))).withColumn("model", F.lit(model))


def word_numbers(texts: Sequence[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """A stand-in for a tokeniser: checksums of words in lower case, the first length of a text."""
    found = [[zlib.crc32(w.encode()) for w in t.lower().split()[:length]] for t in texts]
    wide = max(map(len, found), default=0)
    ids, mask = np.zeros((len(found), wide), np.int64), np.zeros((len(found), wide), np.int64)
    for i, ws in enumerate(found):
        ids[i, : len(ws)], mask[i, : len(ws)] = ws, 1
    return ids, mask


def wave_states(dim: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A stand-in for a model: each number as a wave over the places of a vector."""
    return lambda ids, mask: np.sin(ids[:, :, None] % 10_007 * np.arange(1, dim + 1))


def stand_in(dim: int = 32, length: int = 256) -> Pooled:
    """An embedder without a model file, for tests and where none is at hand."""
    return Pooled(f"waves-{dim}", dim, word_numbers, wave_states(dim), length)
