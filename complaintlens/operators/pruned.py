"""Exact cosine search that reads only the clusters that can hold a hit.

At write time, vectors are assigned to the nearest of a few pivots (taken from the vectors of smallest hash, a bounded
sample) and written in one folder per cluster, with a side table of each cluster's pivot, size and radius: the largest angle
between the pivot and a vector of the cluster. For a question q, no vector v of cluster c is closer in angle than
angle(q, pivot) - radius, so cos(max(0, angle(q, pivot) - radius)) bounds its cosine from above (triangle inequality on the
sphere). A search first reads, per question, the clusters of highest bound until they hold k vectors, which gives a k-th score;
then all clusters whose bound reaches that score for some question. The folders of the others are not read (partition pruning),
and the rows equal those of ``retrieval.retrieve``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.operators.retrieval import DEFAULT_K, retrieve, unit_matrix

PIVOTS = 64
# Angles are widened by this much, so that rounding never prunes a cluster that holds a hit.
SLACK = 1e-6


def _nearest(pivots: np.ndarray, width: int, vector: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_matrix(batch.column(vector), width)
            dots = np.clip(unit @ pivots.T, -1.0, 1.0)
            best = dots.argmax(axis=1)
            angle = np.arccos(dots[np.arange(len(best)), best])
            # A zero vector has no direction: every cluster may take it, with the widest angle.
            angle[~unit.any(axis=1)] = np.pi
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(angle, pa.float64())], names=["cluster", "angle"])

    return assign


def write_clustered(vectors: DataFrame, path: str, width: int, key: str = "chunk_id", vector: str = "embedding", pivots: int = PIVOTS) -> None:
    """``vectors`` written at ``path``/vectors in a folder per cluster, and ``path``/clusters (cluster, pivot, n, radius)."""
    spark = vectors.sparkSession
    sample = vectors.select(vector).orderBy(F.xxhash64(vector)).limit(pivots).toArrow()  # ``pivots`` rows
    centres = unit_matrix(sample.column(0), width) if sample.num_rows else np.zeros((0, width))
    centres = centres[centres.any(axis=1)]
    if not len(centres):
        centres = np.eye(1, width)
    marked = vectors.select(key, vector).mapInArrow(_with_cluster(centres, width, vector, key), _schema(vectors, key, vector))
    marked.write.partitionBy("cluster").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    found = stored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toArrow()  # a row per pivot
    radius = dict(zip(found["cluster"].to_pylist(), found["radius"].to_pylist()))
    sizes = dict(zip(found["cluster"].to_pylist(), found["n"].to_pylist()))
    rows = [(c, centres[c].tolist(), sizes.get(c, 0), radius.get(c, 0.0)) for c in range(len(centres))]
    spark.createDataFrame(rows, "cluster int, pivot array<double>, n long, radius double").write.parquet(f"{path}/clusters")


def _schema(vectors: DataFrame, key: str, vector: str):
    from pyspark.sql import types as T

    return T.StructType([vectors.schema[key], vectors.schema[vector], T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])


def _with_cluster(centres: np.ndarray, width: int, vector: str, key: str):
    nearest = _nearest(centres, width, vector)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = next(nearest(iter([batch])))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), found.column(0), found.column(1)], names=[key, vector, "cluster", "angle"])

    return mark


def _bounds(questions: np.ndarray, clusters: pa.Table) -> np.ndarray:
    """Upper bounds of the cosine between each question (rows) and any vector of each cluster (columns)."""
    pivots = np.array(clusters["pivot"].to_pylist(), dtype=np.float64).reshape(clusters.num_rows, -1)
    radius = np.array(clusters["radius"].to_pylist(), dtype=np.float64) + SLACK
    angle = np.arccos(np.clip(questions @ pivots.T, -1.0, 1.0)) - SLACK
    return np.cos(np.clip(angle - radius[None, :], 0.0, np.pi))


def search_clustered(
    spark: SparkSession, path: str, questions: DataFrame, k: int = DEFAULT_K, width: int = 384, key: str = "chunk_id", vector: str = "embedding",
    question_id: str = "question_id", question_vector: str = "question_vec",
) -> tuple[DataFrame, int, int]:
    """Best k of each question (the rows of ``retrieve``), the number of clusters read and the number there are.

    The questions are held by the driver (as ``retrieve`` does, slice by slice); the side table has a row per pivot.
    """
    clusters = spark.read.parquet(f"{path}/clusters").filter("n > 0").orderBy("cluster").toArrow()
    stored = spark.read.parquet(f"{path}/vectors")
    asked = questions.select(question_id, question_vector).toArrow()
    if not asked.num_rows or not clusters.num_rows:
        return retrieve(stored.limit(0), questions, k, width, key, vector, question_id, question_vector), 0, clusters.num_rows
    bounds = _bounds(unit_matrix(asked.column(1), width), clusters)
    ids, sizes = np.array(clusters["cluster"].to_pylist()), np.array(clusters["n"].to_pylist())
    # First read: per question, the clusters of highest bound until they hold k vectors.
    first = set()
    for row in bounds:
        order = np.argsort(-row, kind="stable")
        enough = np.searchsorted(np.cumsum(sizes[order]), k) + 1
        first |= set(ids[order[:enough]].tolist())
    hits = retrieve(stored.filter(F.col("cluster").isin(sorted(first))), questions, k, width, key, vector, question_id, question_vector)
    kth = {r[0]: r[1] for r in hits.groupBy(question_id).agg(F.min("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(question_id, "min(score)").collect()}
    needed = set(first)
    for name, row in zip(asked.column(0).to_pylist(), bounds):
        floor = kth.get(name)
        needed |= set(ids[row >= (floor - 1e-9 if floor is not None else -np.inf)].tolist())
    if needed == first:
        return hits, len(needed), clusters.num_rows
    final = retrieve(stored.filter(F.col("cluster").isin(sorted(needed))), questions, k, width, key, vector, question_id, question_vector)
    return final, len(needed), clusters.num_rows
