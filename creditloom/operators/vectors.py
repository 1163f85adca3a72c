"""Hashed bag-of-words vectors.

The words of an Arrow batch are hashed once each and counted into dense arrays by
one NumPy call, so a text never leaves its row and nothing is shuffled. The hash
is md5, the same in every process and engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as X
from ..functions.workers import lean

WORDS_HELD = 200_000  # distinct words a task remembers before it starts afresh
TEXTS = 500  # of a batch, split into words at a time


def _bucket(word: str, size: int) -> int:
    return int.from_bytes(md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big") % size


def _as_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=kind))


def hashed_counts(text: Column, size: int = X.VECTOR_SIZE) -> Column:
    """array<int> of length `size`: how many words of each bucket a text has; none for a null text."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in lean(batches):
            parts = []
            for at in range(0, len(batch), TEXTS):
                words = [text.split() for text in batch.slice(at, TEXTS).to_pylist()]
                every = list(chain.from_iterable(words))
                new = set(every).difference(known)
                if len(known) + len(new) > WORDS_HELD:
                    known.clear()
                    new = set(every)
                known.update((word, _bucket(word, size)) for word in new)
                rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
                buckets = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
                flat = np.bincount(rows * size + buckets, minlength=len(words) * size)
                parts.append(flat.reshape(len(words), size).astype(np.int32))
            yield _as_lists(np.concatenate(parts) if parts else np.zeros((0, size), np.int32), pa.int32())

    # In lower case by the JVM, as in SQL; what splits words in Python is what `strip` cuts.
    return count(F.coalesce(F.lower(text), F.lit("")))


def unit(counts: Column, size: int = X.VECTOR_SIZE) -> Column:
    """array<float> of length 1; an all-zero vector stays zero."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def normalise(lists: pa.Array) -> pa.Array:
        matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size).astype(np.float64)
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return _as_lists((matrix / np.where(norm == 0, 1.0, norm)).astype(np.float32), pa.float32())

    return normalise(counts)


def with_counts(df: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    return df.withColumn(name, hashed_counts(F.col(text)))


def weights(df: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Sparse form of the unit vectors: (keys, bucket, n, weight), zeros left out."""
    squares = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long") * c)
    # The inner form would be guarded by a filter that computes the vectors once more.
    rows = df.withColumn("squares", squares).select(*keys, "squares", F.posexplode_outer(counts).alias("bucket", "n"))
    return rows.filter("n > 0").select(
        *keys, "bucket", "n", F.round(F.col("n") / F.sqrt(F.col("squares").cast("double")), 6).alias("weight"))


def vectors_for(df: DataFrame, text: str = "text", vector: str | None = None) -> DataFrame:
    """Adds `vector`: the given vector column where there is one, else the hashed form."""
    if vector is not None:
        return df.withColumn("vector", F.col(vector))
    return df.withColumn("vector", unit(hashed_counts(F.col(text))))
