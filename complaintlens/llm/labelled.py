"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_ids(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int, max_per_class: int) -> DataFrame:
    """(id, label) of at most ``max_per_class`` rows of each of the labels 0 and 1, chosen by a hash of the id.

    Rows of the held-out fold, null ids and null labels are left out; of rows that repeat an id, one of its largest label stays.
    The result is held by the driver, so it is safe to broadcast.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.filter(remainder("id", folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    parts = [rows.filter(F.col("label") == label).orderBy(order, "id").limit(max_per_class) for label in (0, 1)]
    picked = parts[0].unionByName(parts[1]).toArrow()
    return labels.sparkSession.createDataFrame(picked, rows.schema)
