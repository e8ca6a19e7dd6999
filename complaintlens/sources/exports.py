"""Tables of text, vector and metadata: reading, shaping, writing, checking.

One table keeps the vector and its metadata together under ``chunk_id``. Metadata reads do
not touch the vectors, since parquet reads only the columns asked for.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from complaintlens.functions.vectors import check_finite, check_width, is_finite, l2_normalize
from complaintlens.sources.columns import (
    TEXT_NAMES,
    VECTOR_NAMES,
    VectorColumns,
    detect_schema,
    resolve_column,
)

ROW_ID = "chunk_id"


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, VectorColumns]:
    """The needed columns of a parquet export and where they are. Others are not read.

    An export without an id gets one, ``chunk_id``, from the file and the place in it of each row. It stays the
    same as long as the files do.
    """
    raw = spark.read.parquet(path)
    found = detect_schema(raw.columns)
    needed = [F.col(f"`{name}`") for name in found.needed()]
    if found.id is None:
        needed.append(row_id())
        found = replace(found, id=ROW_ID)
    return raw.select(*needed), found


def row_id() -> Column:
    """File and row of a scan as text."""
    return F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias(ROW_ID)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A whole table of vectors; it must have an ``embedding`` column."""
    df = spark.read.parquet(path)
    if "embedding" not in df.columns:
        raise ValueError(f"no 'embedding' column in {path}; found {df.columns}")
    return df


def json_schema(df: DataFrame, column: str) -> str | None:
    """Struct type with the union of the keys in a column of JSON texts; None if there are none.

    One aggregation; texts that are not JSON objects count as having no keys.
    """
    parsed = F.try_parse_json(F.col(column))
    objects = F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed)
    text = df.agg(F.schema_of_variant_agg(objects)).first()[0]
    if not text or not text.startswith("OBJECT<") or text == "OBJECT<>":
        return None
    # Types stand after a colon, after ARRAY< or at the start; a key can have the same name. Keys that are null
    # throughout have no type of their own.
    text = re.sub(r"(^|: |ARRAY<)OBJECT<", r"\1STRUCT<", text)
    return re.sub(r"(: |ARRAY<)VOID(?=[,>])", r"\1STRING", text)


def expand_metadata(df: DataFrame, column: str) -> DataFrame:
    """One column per key of a struct column or of a column of JSON texts; the column itself goes.

    A text that is not a JSON object gives nulls. A key named like a column of the table or an earlier
    key, case aside, is kept under ``{column}_{key}``.
    """
    if not isinstance(df.schema[column].dataType, T.StructType):
        schema = json_schema(df, column)
        if schema is None:
            return df.drop(column)
        df = df.withColumn(column, F.from_json(F.col(column), schema))
    taken = {name.lower() for name in df.columns if name != column}
    names = []
    for key in df.schema[column].dataType.names:
        while key.lower() in taken:
            key = f"{column}_{key}"
        taken.add(key.lower())
        names.append(key)
    kept = [F.col(f"`{name}`") for name in df.columns if name != column]
    # By place, since keys that differ in case only cannot be told apart by name.
    return df.select(*kept, F.inline(F.array(F.col(f"`{column}`"))).alias(*names))


def chunk_vectors(df: DataFrame, found: VectorColumns) -> DataFrame:
    """A resolved export under the common names: chunk_id, chunk_text, embedding, metadata."""
    wide = expand_metadata(df, found.nested) if found.nested else df
    names = {found.text: "chunk_text", found.vector: "embedding"}
    if found.id:
        names[found.id] = "chunk_id"
    # Another column that already has one of the common names is kept under ``source_{name}``.
    taken = {name.lower() for name in names.values()}
    return wide.select(
        *[F.col(f"`{c}`").alias(names.get(c) or (f"source_{c}" if c.lower() in taken else c)) for c in wide.columns]
    )


def checked_index(df: DataFrame, width: int, normalize: bool = True) -> DataFrame:
    """Vectors at length one, as ``array<float>``; the job fails on another width, null, NaN or infinity."""
    vector = check_finite(check_width(F.col("embedding").cast("array<float>"), width))
    if normalize:
        vector = l2_normalize(vector)
    return df.withColumn("embedding", vector.cast("array<float>"))


def build_index(spark: SparkSession, path: str, width: int, normalize: bool = True) -> DataFrame:
    """Export at ``path`` to the table that searches read. Narrow: one stage from scan to write."""
    raw, found = read_vectors(spark, path)
    return checked_index(chunk_vectors(raw, found), width, normalize)


def width_violations(df: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """Number of vectors, of those without a vector of the given width, and of those that are not finite."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    return df.agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_if(size != width).alias("n_wrong_width"),
        F.count_if(~is_finite(F.col(vector))).alias("n_non_finite"),
    )


def write_chunk_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def to_metadata(df: DataFrame) -> DataFrame:
    """Without the vector; text and id under ``chunk_text`` and ``chunk_id``."""
    plain = df.drop(*VECTOR_NAMES)
    names = {resolve_column(plain.columns, *TEXT_NAMES): "chunk_text"}
    names.update({name: "chunk_id" for name in plain.columns if name.lower() == "id"})
    return plain.withColumnsRenamed(names)


def write_metadata(df: DataFrame, path: str) -> None:
    df.drop(*VECTOR_NAMES).write.mode("overwrite").parquet(path)


def fill_metadata(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null to empty in text columns; numbers stay as they are."""
    texts = [
        field.name
        for field in df.schema
        if isinstance(field.dataType, T.StringType) and (columns is None or field.name in columns)
    ]
    return df.na.fill("", subset=texts) if texts else df


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A later batch with the columns, types and order of the first; missing columns are null, further ones follow."""
    have = set(df.columns)
    known = [
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return df.select(*known, *[F.col(f"`{c}`") for c in df.columns if c not in schema.names])


def append_batches(first: DataFrame, *later: DataFrame) -> DataFrame:
    """Batches of one export with the union of their columns, under the types of the batch that has a column first."""
    result = first
    for batch in later:
        result = result.unionByName(align_to_schema(batch, result.schema), allowMissingColumns=True)
    return result


def _key_counts(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Rows per key in either table, from one aggregation: one shuffle for the pair."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = vectors.select(key, one.alias("v"), zero.alias("m")).unionAll(
        metadata.select(key, zero.alias("v"), one.alias("m"))
    )
    return sides.groupBy(key).agg(F.sum("v").alias("n_vectors"), F.sum("m").alias("n_metadata"))


def key_differences(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that the two tables do not have equally often, with both numbers."""
    return _key_counts(vectors, metadata, key).filter(F.col("n_vectors") != F.col("n_metadata"))


def index_mismatch(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Row counts of both tables, the numbers of keys only one of them has, and of keys not equally often in both."""
    return _key_counts(vectors, metadata, key).agg(
        F.coalesce(F.sum("n_vectors"), F.lit(0)).alias("n_vectors"),
        F.coalesce(F.sum("n_metadata"), F.lit(0)).alias("n_metadata"),
        F.count_if(F.col("n_metadata") == 0).alias("only_vectors"),
        F.count_if(F.col("n_vectors") == 0).alias("only_metadata"),
        F.count_if(F.col("n_vectors") != F.col("n_metadata")).alias("unequal_keys"),
    )


def load_index_and_metadata(
    spark: SparkSession, vectors: str, metadata: str, key: str = "chunk_id"
) -> tuple[DataFrame, DataFrame]:
    """Both tables, refused if their keys differ."""
    left, right = spark.read.parquet(vectors), spark.read.parquet(metadata)
    check = index_mismatch(left, right, key).first()
    if check.unequal_keys:
        raise ValueError(
            f"vectors and metadata differ: {check.n_vectors} vectors, {check.n_metadata} metadata rows, "
            f"{check.only_vectors} keys only with a vector, {check.only_metadata} only with metadata, "
            f"{check.unequal_keys} not equally often in both; "
            "build both again"
        )
    return left, right


def index_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_vectors"))


def metadata_as_variant(df: DataFrame, column: str) -> DataFrame:
    """The column of JSON texts as VARIANT, parsed row by row without a pass to find its keys; a text that is not JSON is null.

    A stream can carry it so, since no schema is needed; keys are read later with ``metadata_values``.
    """
    return df.withColumn(column, F.try_parse_json(F.col(column)))


def metadata_values(df: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """One column per entry of ``keys`` (name: Spark type) read from the VARIANT ``column``, which goes; a missing key or a
    value that cannot be cast is null. A key named like a column of the table is kept under ``{column}_{key}``."""
    taken = {name.lower() for name in df.columns if name != column}
    values = []
    for key, kind in keys.items():
        name = f"{column}_{key}" if key.lower() in taken else key
        taken.add(name.lower())
        path = "$." + key if key.isidentifier() else f"$['{key}']"
        values.append(F.try_variant_get(F.col(column), path, kind).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *values)


def vector_checks(width: int, vector: str = "embedding") -> list[Column]:
    """Number of vectors, of those without a vector of the given width, and of those that are not finite."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    return [
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(size != width).alias("n_wrong_width"),
        F.count_if(~is_finite(F.col(vector))).alias("n_non_finite"),
    ]


def write_observed(df: DataFrame, path: str, width: int, vector: str = "embedding") -> dict[str, int]:
    """Writes ``df`` as parquet and returns the figures of ``width_violations``, counted by the writing job itself.

    The figures are an observation of the write (``DataFrame.observe``): no second pass over the table.
    """
    from pyspark.sql import Observation

    seen = Observation("vector-checks")
    df.observe(seen, *vector_checks(width, vector)).write.parquet(path)
    return dict(seen.get)
