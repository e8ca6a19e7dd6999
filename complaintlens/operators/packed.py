"""Vectors packed into blocks, searched in float32 with an error bound and rescored exactly.

A block row holds up to ``block_rows`` vectors as one little-endian float32 binary, their ids and their lengths (double).
Packing is narrow: each task cuts its own rows into blocks, nothing is shuffled. A search reads a block's binary without a
copy, scores all its vectors against the questions in float32, and keeps those whose float32 cosine is within twice the
error bound of the k-th best of the block: the exact top k of the block is among them. Only those are scored again in double,
exactly as ``retrieval.retrieve`` scores (unit vectors in double, rounded to 12 decimals, ties by id), so the rows are the
same as there. A block sends at most the candidates within that bound per question, mostly about ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from complaintlens.operators.retrieval import DEFAULT_K, MAX_QUESTION_BYTES, SCORE_DIGITS, _ranked, matrix_of, unit_matrix
from complaintlens.session import written_once

BLOCK_ROWS = 4096
UNIT_ROUNDOFF = 2.0**-24


def error_bound(width: int) -> float:
    """Largest difference between the float32 cosine of a block and the exact one, with room for the final rounding.

    A float32 dot product of length d is within gamma_d * |v| |q| of the exact one (gamma_d = d u / (1 - d u), u = 2^-24);
    rounding the unit question to float32 adds u |v|; dividing by |v| and the 12-digit rounding of exact scores add less
    than the factor 2 covers.
    """
    gamma = width * UNIT_ROUNDOFF / (1 - width * UNIT_ROUNDOFF)
    return 2 * (gamma + UNIT_ROUNDOFF) + 10.0**-SCORE_DIGITS


def pack_vectors(vectors: DataFrame, key: str = "chunk_id", vector: str = "embedding", width: int = 384, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of up to ``block_rows`` vectors: ids, n, width, vectors (float32 binary), lengths (float64 binary).

    Fails on a null vector or one of another width, as the search does. Write it with compression off: random floats do not
    compress, and the search then maps the bytes as they are read.
    """
    id_type = vectors.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("vectors", T.BinaryType()),
            T.StructField("lengths", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                matrix = matrix_of(part.column(1), width).astype(np.float32)
                lengths = np.sqrt(np.einsum("ij,ij->i", matrix.astype(np.float64), matrix.astype(np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)),
                        pa.array([part.num_rows], pa.int32()),
                        pa.array([width], pa.int32()),
                        pa.array([matrix.tobytes()], pa.binary()),
                        pa.array([lengths.tobytes()], pa.binary()),
                    ],
                    names=["ids", "n", "width", "vectors", "lengths"],
                )

    return vectors.select(key, vector).mapInArrow(pack, schema)


def _block_hits(questions: np.ndarray, k: int, slack: float):
    """Per block: the exact best ``k`` of each question, (question number, position in block, score)."""
    unit32 = questions.astype(np.float32)

    def hits(raw: pa.Buffer, lengths: pa.Buffer, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = np.frombuffer(raw, np.float32, n * width).reshape(n, width)
        norms = np.frombuffer(lengths, np.float64, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = np.where(norms[:, None] > 0, (block @ unit32.T) / norms[:, None], 0.0)
        if n > k:
            kth = np.partition(rough, n - k, axis=0)[n - k]
            rows, qs = np.nonzero(rough >= kth - slack)
        else:
            rows, qs = np.nonzero(np.ones_like(rough, bool))
        if not len(rows):
            return rows, rows, np.zeros(0)
        picked = np.unique(rows)
        # As ``retrieval.unit_matrix`` makes them: float32 values in double, divided by their length unless zero.
        exact = block[picked].astype("float64")
        length = np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]
        np.divide(exact, length, out=exact, where=length > 0)
        scores = np.round(exact @ questions.T, SCORE_DIGITS) + 0.0
        where = np.searchsorted(picked, rows)
        return qs, rows, scores[where, qs]

    return hits


def search_packed(
    blocks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    width: int = 384,
    key: str = "chunk_id",
    question_id: str = "question_id",
    question_vector: str = "question_vec",
    max_question_bytes: int = MAX_QUESTION_BYTES,
) -> DataFrame:
    """Best k vectors of each question from packed ``blocks``: question_id, key, score, rank; the rows of ``retrieve``."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    asked = written_once(questions.select(question_id, question_vector), "questions")
    slices = max(1, math.ceil(asked.count() * 8 * width / max(8 * width, max_question_bytes)))
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(question_id, questions.schema[question_id].dataType), T.StructField(key, id_type), T.StructField("score", T.DoubleType())])
    number = F.pmod(F.xxhash64(question_id, question_vector), F.lit(slices))
    slack = error_bound(width)
    found = []
    for i in range(slices):
        part = asked.filter(number == i).toArrow()
        names = part.column(0).combine_chunks()
        hits = _block_hits(unit_matrix(part.column(1), width), k, slack)

        def search(batches: Iterator[pa.RecordBatch], names=names, hits=hits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    n = batch.column("n")[row].as_py()
                    if batch.column("width")[row].as_py() != width:
                        raise ValueError(f"expected vectors of width {width}")
                    qs, rows, scores = hits(batch.column("vectors")[row].as_buffer(), batch.column("lengths")[row].as_buffer(), n, width)
                    if not len(qs):
                        continue
                    ids = batch.column("ids")[row].values
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(qs)), ids.take(pa.array(rows)), pa.array(scores, pa.float64())], schema=pa.schema([(f.name, _arrow(f.dataType)) for f in schema])
                    )

        candidates = blocks.select("ids", "n", "width", "vectors", "lengths").mapInArrow(search, schema)
        found.append(candidates if slices == 1 else written_once(candidates, "packed-hits"))
    return _ranked(reduce(DataFrame.unionByName, found), question_id, key, k)


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def top_k_packed_single(blocks: DataFrame, question, key: str = "chunk_id", k: int = DEFAULT_K) -> DataFrame:
    """Best k rows of packed ``blocks`` for one question vector: key, score."""
    width = len(question)
    slack = error_bound(width)
    column = pa.array([list(map(float, question))], pa.list_(pa.float64()))
    hits = _block_hits(unit_matrix(column, width), k, slack)
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(key, id_type), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best_scores = [], []
        for batch in batches:
            for row in range(batch.num_rows):
                _, rows, scores = hits(batch.column("vectors")[row].as_buffer(), batch.column("lengths")[row].as_buffer(), batch.column("n")[row].as_py(), width)
                best_ids.append(batch.column("ids")[row].values.take(pa.array(rows)))
                best_scores.append(scores)
        if best_ids:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(best_ids), pa.array(np.concatenate(best_scores), pa.float64())], schema=arrow)

    found = blocks.select("ids", "n", "width", "vectors", "lengths").mapInArrow(search, schema)
    return found.orderBy(F.desc("score"), key).limit(k)
