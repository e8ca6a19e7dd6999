"""Complaint tables as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells that a CSV export means as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns of the cleaned table, in order.
CLEAN_COLUMNS = (
    "complaint_id", "product_category", "product", "issue", "company", "state",
    "date_received", "narrative", "clean_narrative", "clean_word_count",
)

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_complaints_csv(
    spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True
) -> DataFrame:
    """A CSV with a header as strings, cells that mean missing as null.

    Each file's header must have the names of ``columns`` in that order, and each row as many cells; the job fails
    on another file or row rather than reading cells under wrong names or dropping some. With ``columns`` no pass over the data is needed to infer a
    schema. A file with line ends inside cells cannot be split, so each file is one task:
    export in many files, and go on from parquet (``write_clean``) after the first read.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    strict = {"enforceSchema": "false", "mode": "FAILFAST", "columnPruning": "false"}
    raw = spark.read.options(multiLine=str(multi_line).lower(), **_CSV, **strict).schema(schema).csv(path)
    cells = [
        F.when(F.col(f"`{name}`").isin(*NULL_TOKENS), F.lit(None))
        .otherwise(F.col(f"`{name}`"))
        .alias(name)
        for name in columns
    ]
    return raw.select(*cells)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV, from its first line."""
    return spark.read.options(multiLine="true", **_CSV).csv(path).columns


def write_clean_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def write_clean(df: DataFrame, path: str) -> None:
    """The cleaned table as parquet, the form further jobs read."""
    df.write.mode("overwrite").parquet(path)
