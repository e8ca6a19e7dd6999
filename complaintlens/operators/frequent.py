"""The n most frequent values of a wide column without counting every value.

Each task counts its own values and keeps the ``capacity`` most frequent with their counts, and the largest count it did
not keep (its residual). A value that no task kept occurs at most the sum of the residuals, R, in the whole table. The kept
values are the candidates; one filtered pass counts them exactly. If the n-th exact count exceeds R, no other value can reach
the top n or tie with it, so the top n is proven complete; otherwise the column is counted in full. What crosses the shuffle is
at most ``capacity`` rows a task, and then one row a task per candidate: it does not grow with the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from complaintlens.operators.dashboard import top_values
from complaintlens.session import local_if_small

CAPACITY = 1000


def summaries(df: DataFrame, column: str, capacity: int) -> DataFrame:
    """Per task: up to ``capacity`` (value, count) of its most frequent non-null values, and a row with a null value whose
    count is its residual (the largest count it did not keep, 0 if none)."""
    kind = df.schema[column].dataType

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[value] = counts.get(value, 0) + n
        ranked = sorted(counts.items(), key=lambda item: -item[1])
        kept, rest = ranked[:capacity], ranked[capacity:]
        residual = rest[0][1] if rest else 0
        values = [v for v, _ in kept] + [None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, type=_arrow(kind)), pa.array([n for _, n in kept] + [residual], pa.int64())], names=["value", "n"]
        )

    schema = T.StructType([T.StructField("value", kind), T.StructField("n", T.LongType())])
    return df.select(column).mapInArrow(summarise, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def top_frequent(df: DataFrame, column: str, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``dashboard.top_values(df, column, n)``: value, n, rank; the ``n`` most frequent non-null values, ties by
    value. Exact: candidates are counted exactly, and the full count is made when the summaries cannot prove the top n."""
    found = summaries(df, column, max(capacity, n)).cache()
    try:
        residual = found.filter(F.col("value").isNull()).agg(F.sum("n")).first()[0] or 0
        candidates = local_if_small(found.filter(F.col("value").isNotNull()).select("value").distinct())
        if candidates is None:
            return top_values(df, column, n)
        exact = top_values(df.join(F.broadcast(candidates), df[column] == candidates["value"], "left_semi"), column, n)
        held = exact.collect()  # n rows at most
    finally:
        found.unpersist()
    if len(held) == n and held[-1]["n"] > residual:
        return df.sparkSession.createDataFrame(held, exact.schema)
    if residual == 0:
        # Every value of every task was kept: the candidates are all the values.
        return df.sparkSession.createDataFrame(held, exact.schema)
    return top_values(df, column, n)
