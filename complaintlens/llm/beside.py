"""Python tasks that leave the other columns of a row alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_beside(rows: DataFrame, keep: list[str], compute: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], made: str) -> DataFrame:
    """The columns ``keep`` of ``rows`` as they are, and the columns ``made`` (DDL) that ``compute`` makes of the others.

    ``compute`` gets the rows of a batch and gives frames with a row for each, in the same order. What is kept stays in Arrow:
    pandas turns whole numbers beside a null into floats, which rounds those above 2^53.
    """
    fields = StructType.fromDDL(made)
    arrow, names = to_arrow_schema(fields), [*keep, *fields.names]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            others = {name: pd.Series(batch.column(name).to_pylist(), dtype=object) for name in batch.schema.names if name not in keep}
            for frame in compute(pd.DataFrame(others)):
                found = pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
                kept = batch.slice(at, len(frame))
                at += len(frame)
                yield pa.RecordBatch.from_arrays([*(kept.column(name) for name in keep), *found.columns], names=names)

    return rows.mapInArrow(beside, StructType([*(rows.schema[name] for name in keep), *fields]))
