"""Exact cosine search over a table of vectors.

Each task multiplies Arrow batches of vectors with the matrix of questions and keeps the best
k per question over all its batches, so ``tasks * k * questions`` rows cross the shuffle and
never a row per pair, and never a vector.

The questions go to every task in slices whose vectors fit ``max_question_bytes``. There is one
pass over the vectors per slice; the driver holds one slice at a time.

A vector of another width or with a component that is null, NaN or infinite stops the job: it
has no place in an order by score.

Scores are computed in double and rounded to 12 decimals before ranking, so copies of a
vector tie exactly and are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from complaintlens.session import settled, written_once

DEFAULT_K = 5
MAX_QUESTION_BYTES = 32 * 1024 * 1024
SCORE_DIGITS = 12
MAX_SCORES = 8_000_000
# Rows of an Arrow batch that are turned into doubles and scored at once.
BLOCK_ROWS = 2_048


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix; fails on a null or a row of another width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    wrong = lengths[lengths != width]
    if len(wrong):
        raise ValueError(f"expected vectors of width {width}, found width {wrong[0]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unit_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows at length one, a zero vector as it is; fails on one that is not finite."""
    matrix = matrix_of(column, width).astype("float64")
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    if not np.isfinite(lengths).all():
        raise ValueError("a vector is not finite")
    return np.divide(matrix, lengths, out=matrix, where=lengths > 0)


class BestHits:
    """The best k ids per question over the batches seen so far."""

    def __init__(self, k: int, questions: np.ndarray) -> None:
        self.k = k
        self.questions = questions
        self.floor = np.full(len(questions), -np.inf)
        self.hits = pd.DataFrame({"q": np.array([], "int64"), "score": [], "id": []})

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        """Takes in a batch, in blocks whose scores fit ``MAX_SCORES``. A null id is refused: beside it, whole-number ids
        would pass through pandas as floats and lose digits above 2^53."""
        if ids.null_count:
            raise ValueError("a vector without an id cannot be a hit")
        rows = max(1, MAX_SCORES // max(1, len(self.questions)))
        for start in range(0, len(vectors), rows):
            self._add_block(ids.slice(start, rows), vectors[start : start + rows])

    def _add_block(self, ids: pa.Array, vectors: np.ndarray) -> None:
        scores = np.round(vectors @ self.questions.T, SCORE_DIGITS) + 0.0  # no negative zero
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            self.floor = np.maximum(self.floor, kth)
        # Ties with the floor stay in: a smaller id may still displace one.
        row, q = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        new = pd.DataFrame({"q": q, "score": scores[row, q], "id": ids.take(pa.array(row)).to_pandas()})
        both = new if self.hits.empty else pd.concat([self.hits, new], ignore_index=True)
        both = both.sort_values(["q", "score", "id"], ascending=[True, False, True])
        self.hits = both.groupby("q", sort=False).head(self.k)
        full = self.hits.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index] = np.maximum(self.floor[full.index], full["min"])


def _ranked(candidates: DataFrame, question_id: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), key)
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_single(
    vectors: DataFrame,
    question: Sequence[float],
    key: str = "chunk_id",
    vector: str = "embedding",
    k: int = DEFAULT_K,
) -> DataFrame:
    """Best k rows for one question vector: key, score. Fails on a vector of another width."""
    column = pa.array([list(map(float, question))], pa.list_(pa.float64()))
    schema = T.StructType([T.StructField("_q", T.LongType()), vectors.schema[key], T.StructField("score", T.DoubleType())])
    hits = _candidates(vectors, pa.array([0]), unit_matrix(column, len(question)), schema, k, key, vector)
    return hits.select(key, "score").orderBy(F.desc("score"), key).limit(k)


def _hit_schema(vectors: DataFrame, key: str, questions: DataFrame, question_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(question_id, questions.schema[question_id].dataType),
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _as_table(best: BestHits, names: pa.Array, schema: pa.Schema) -> pa.Table:
    hits = best.hits
    columns = [
        names.take(pa.array(hits["q"].to_numpy("int64"))),
        pa.array(hits["id"], type=schema.field(1).type, from_pandas=True),
        pa.array(hits["score"], type=pa.float64()),
    ]
    return pa.Table.from_arrays(
        [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
    )


def retrieve(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    width: int = 384,
    key: str = "chunk_id",
    vector: str = "embedding",
    question_id: str = "question_id",
    question_vector: str = "question_vec",
    max_question_bytes: int = MAX_QUESTION_BYTES,
) -> DataFrame:
    """Best k vectors of each question: question_id, key, score, rank. Fewer if there are fewer.

    ``key`` and ``question_id`` identify a row of their tables. The questions are computed once and stored, and
    fetched from there slice by slice.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    asked = written_once(questions.select(question_id, question_vector), "questions")
    slices = max(1, math.ceil(asked.count() * 8 * width / max(8 * width, max_question_bytes)))
    schema = _hit_schema(vectors, key, questions, question_id)
    # The content keeps questions that share an id from all falling into one slice.
    number = F.pmod(F.xxhash64(question_id, question_vector), F.lit(slices))
    found = []
    for i in range(slices):
        part = asked.filter(number == i).toArrow()
        names = part.column(0).combine_chunks()
        hits = _candidates(vectors, names, unit_matrix(part.column(1), width), schema, k, key, vector)
        # Stored before the next slice is fetched; a single one need not be.
        found.append(hits if slices == 1 else written_once(hits, "hits"))
    return _ranked(reduce(DataFrame.unionByName, found), question_id, key, k)


def _candidates(
    vectors: DataFrame, names: pa.Array, questions: np.ndarray, schema: T.StructType, k: int, key: str, vector: str
) -> DataFrame:
    """The best k of each task for each of the ``questions``, whose ids are ``names``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(schema), questions.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = BestHits(k, questions)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                found.add(block.column(0), unit_matrix(block.column(1), width))
        yield from _as_table(found, names, arrow).to_batches()

    return vectors.select(key, vector).mapInArrow(best, schema)


def attach_metadata(hits: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with the metadata of their rows, null where there is none.

    ``metadata`` is first cut down to the keys that were hit. Hits of a batch of questions are
    few, so that cut is a broadcast join in the scan; if they are not, both are shuffled.
    """
    stored, small = settled(hits, "hits")
    if not small:
        return stored.join(metadata, key, "left")
    kept = metadata.join(F.broadcast(stored.select(key).distinct()), key, "left_semi")
    return stored.join(kept, key, "left")


def self_retrieval(
    vectors: DataFrame,
    sample: DataFrame,
    width: int = 384,
    key: str = "chunk_id",
    vector: str = "embedding",
) -> DataFrame:
    """For each sampled stored vector: its best hit, the score and whether it found itself."""
    questions = sample.select(F.col(key).alias("question_id"), F.col(vector).alias("question_vec"))
    hits = retrieve(vectors, questions, 1, width, key, vector)
    return hits.select(
        "question_id",
        F.col(key).alias("hit_id"),
        "score",
        ((F.col(key) == F.col("question_id")) & (F.col("score") > 0.999)).alias("found_itself"),
    )
