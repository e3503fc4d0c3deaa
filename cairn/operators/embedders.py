"""Embedders: anything that maps a text column to a vector column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.functions.vectors import hash_embedding


class Embedder(Protocol):
    dimension: int

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """The reproducible stand-in; a text's embedding as a query is the same as as a document."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        return df.withColumn(out, hash_embedding(F.col(text), self.dimension).cast("array<float>"))

    def embed_query(self, text: str) -> list[float]:
        import hashlib

        word = lambda i: int(hashlib.md5(f"{text}:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0
        return np.array([word(i) for i in range(self.dimension)], np.float32).tolist()


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[n, t, d] token vectors and their [n, t] mask -> [n, d] means."""
    m = mask[..., None].astype(np.float64)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def like_lengths(texts: Sequence[str], size: int, chars: int) -> list[list[int]]:
    """Places of texts in batches of at most ``size``, by length, each of at most ``chars`` characters when padded to its longest text, or one text."""
    out: list[list[int]] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if not out or len(out[-1]) >= size or (len(out[-1]) + 1) * len(texts[i]) > chars:
            out.append([])
        out[-1].append(i)
    return out


class ModelEmbedder:
    """A model behind ``load() -> encode(list of texts) -> (token vectors, mask)``; loaded once in each worker.

    Output vectors are pooled and of length 1.  A batch that fails gives zero vectors and sets ``embed_error``;
    there is no silent change to another model.  Batches are made of texts of like lengths: at most ``batch`` of them, and
    no more than make ``batch_chars`` characters when all are padded to the longest.
    """

    def __init__(self, load: Callable[[], Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]], dimension: int, batch: int = 8, batch_chars: int = 1 << 16):
        self.load, self.dimension, self.batch, self.batch_chars = load, dimension, batch, batch_chars

    def _vectors(self, encode, texts: list[str]) -> np.ndarray:
        v = mean_pool(*encode(texts))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        load, size, most, dim, vectors = self.load, self.batch, self.batch_chars, self.dimension, self._vectors
        at, names = df.columns.index(text), [*df.columns, out, "embed_error"]

        def run(parts):
            encode = load()
            for part in parts:
                texts = [t or "" for t in part.column(at).to_pylist()]
                made, failed = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
                for at_ in like_lengths(texts, size, most):
                    try:
                        made[at_] = vectors(encode, [texts[i] for i in at_])
                    except Exception:  # the batch's rows are flagged
                        failed[at_] = True
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, values, pa.array(failed)], names=names)

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("embed_error", T.BooleanType())]))

    def embed_query(self, text: str) -> list[float]:
        return self._vectors(self.load(), [text])[0].tolist()
