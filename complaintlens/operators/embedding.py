"""Text to unit vectors.

An embedder is any object with ``embed(list of str) -> array of shape (n, width)``. Jobs get
a factory, so that the model is loaded once per Python worker and never pickled.
``HashedEmbedder`` stands in where no model is at hand: a bag of words hashed to a fixed
number of buckets. ``hashed_buckets`` gives the same counts as a Spark table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.functions.batches import text_slices

DEFAULT_WIDTH = 384
ENCODE_BATCH = 64
# Tokens whose buckets a worker remembers; each takes about 200 bytes.
KNOWN_TOKENS = 50_000


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


EmbedderFactory = Callable[[], Embedder]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


class HashedEmbedder:
    """Counts of tokens per hash bucket, at length one."""

    def __init__(self, width: int = DEFAULT_WIDTH) -> None:
        self.width = width
        self._bucket = lru_cache(maxsize=KNOWN_TOKENS)(self._hash)

    def _hash(self, token: str) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.width

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.width))
        for row, text in enumerate(texts):
            buckets = [self._bucket(token) for token in text.split(" ") if token]
            counts[row] = np.bincount(buckets, minlength=self.width) if buckets else 0.0
        return _unit_rows(counts)


def hashed(width: int = DEFAULT_WIDTH) -> EmbedderFactory:
    return lambda: HashedEmbedder(width)


def embed(
    df: DataFrame,
    text_col: str,
    factory: EmbedderFactory,
    output: str = "embedding",
    batch: int = ENCODE_BATCH,
) -> DataFrame:
    """Adds the unit vector of a text column, null where the text is null. Narrow."""

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = factory()
        for texts in (some for part in parts for some in text_slices(part)):
            known = texts.drop_null().to_pylist()
            blocks = [
                _unit_rows(np.asarray(embedder.embed(known[start : start + batch]), dtype="float64")).astype("float32")
                for start in range(0, len(known), batch)
            ]
            found = np.concatenate(blocks) if blocks else np.zeros((0, 0), "float32")
            # One flat array of numbers; a null text takes none of them.
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            ends = np.cumsum(~missing) * found.shape[1]
            offsets = np.concatenate([[0], ends]).astype("int32")
            yield pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(found.ravel()), mask=pa.array(missing)
            )

    return df.withColumn(output, vectors(F.col(text_col)))


def hashed_buckets(df: DataFrame, key: str, text_col: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Non-zero counts of ``HashedEmbedder`` as rows (key, bucket, n), on built-in expressions."""
    tokens = df.select(key, F.explode(F.split(text_col, " ")).alias("token")).filter(F.col("token") != "")
    number = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long")
    return (
        tokens.select(key, F.pmod(number, F.lit(width)).cast("int").alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
