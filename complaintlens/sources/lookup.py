"""Metadata stored for lookups by key: files by range of the key, sorted within, with bloom filters.

A search hits few keys. Written by range of the key and sorted, each file and row group covers a narrow range, so the min and
max statistics of a row group exclude it for most keys; a bloom filter on the key excludes most of the rest. A lookup passes
the keys as an ``IN`` filter that reaches the Parquet reader, which skips the row groups that cannot hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.session import local_if_small

ROWS_PER_FILE = 1_000_000
ROW_GROUP_BYTES = 8 * 1024 * 1024
MAX_KEYS = 100_000


def write_lookup_table(df: DataFrame, path: str, key: str, files: int | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """``df`` written at ``path`` by ranges of ``key``, sorted within each file, with a bloom filter on ``key``."""
    files = files or max(1, -(-df.count() // rows_per_file))
    laid = df.repartitionByRange(files, F.col(key)).sortWithinPartitions(key)
    (
        laid.write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )


def lookup(spark: SparkSession, path: str, key: str, keys: list) -> DataFrame:
    """The rows of the table at ``path`` whose ``key`` is one of ``keys``; the filter is pushed to the reader."""
    return spark.read.parquet(path).filter(F.col(key).isin(keys))


def attach_looked_up(hits: DataFrame, path: str, key: str) -> DataFrame:
    """``hits`` with the columns of the lookup table at ``path``, null where it has no row; the keys of the hits (at most
    ``MAX_KEYS``, else the table is joined whole) are looked up, so only row groups that can hold them are read."""
    spark = hits.sparkSession
    held = local_if_small(hits.select(key).distinct(), MAX_KEYS)
    if held is None:
        return hits.join(spark.read.parquet(path), key, "left")
    keys = [row[0] for row in held.collect() if row[0] is not None]
    return hits.join(lookup(spark, path, key, keys), key, "left")
