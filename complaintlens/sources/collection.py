"""Named collections: tables of chunks with their vectors and metadata.

A collection is bucketed by ``chunk_id``, so an append meets the stored keys without
shuffling the stored table.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintlens.sources.exports import fill_metadata

BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 20_000


def _one_row_per_key(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows with each key once, and how many there are.

    Keys are counted without the other columns first. Null keys are refused. Of rows that repeat a key
    the one whose content has the smallest hash stays; without repeats the rows are not touched.
    """
    counts = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    found = counts.agg(F.count("*").alias("keys"), F.max(F.col("k").isNull()).alias("nulls"), F.max("n").alias("most")).first()
    if found.nulls:
        raise ValueError(f"rows without {key}")
    if (found.most or 0) > 1:
        content = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        # First the copies, which are dropped before the shuffle too.
        rows = rows.withColumn("_content", content).dropDuplicates([key, "_content"])
        order = Window.partitionBy(key).orderBy("_content")
        rows = rows.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row", "_content")
    return rows, found["keys"]


def write_collection(
    df: DataFrame,
    name: str,
    path: str | None = None,
    reset: bool = True,
    key: str = "chunk_id",
    buckets: int | None = None,
) -> None:
    """Create the collection anew, or with ``reset=False`` add the chunks it does not have yet.

    Each id is stored once. ``path`` is the shared folder below which the table is put; without it
    the warehouse of the cluster is used. Text metadata is stored without nulls. A new table has a bucket
    per million rows unless told otherwise. A reset writes the new table first and then lets it take the
    name, so a job that fails leaves the old one, and a collection can be rewritten from itself. An
    append may bring new columns, which are null in the rows stored before, and lack others.
    """
    spark: SparkSession = df.sparkSession
    # The key is not filled: a missing one must be seen.
    texts = [name for name in df.columns if name != key]
    rows, keys = _one_row_per_key(fill_metadata(df, texts), key)
    if spark.catalog.tableExists(name) and not reset:
        _append(spark, rows, name, key)
        return
    fresh = f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or min(MAX_BUCKETS, max(1, math.ceil(keys / BUCKET_ROWS)))
    writer = rows.write.bucketBy(buckets, key).format("parquet")
    if path:
        writer = writer.option("path", f"{path.rstrip('/')}/{fresh}")
    writer.saveAsTable(fresh)
    # The old table is put aside before the new one takes the name and dropped last: at no step is a written table lost.
    aside = f"{name}_old_{uuid.uuid4().hex}" if spark.catalog.tableExists(name) else None
    if aside:
        spark.sql(f"ALTER TABLE {name} RENAME TO {aside}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    if aside:
        spark.sql(f"DROP TABLE {aside}")


def _append(spark: SparkSession, rows: DataFrame, name: str, key: str) -> None:
    known = {column.lower() for column in spark.table(name).columns}
    fresh = [field for field in rows.schema if field.name.lower() not in known]
    if fresh:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fresh)})")
    stored = spark.table(name)
    have = {column.lower(): column for column in rows.columns}
    new = rows.join(stored.select(key), key, "left_anti")
    columns = [
        (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in stored.schema
    ]
    # The table says how it is bucketed.
    new.select(*columns).write.insertInto(name)
