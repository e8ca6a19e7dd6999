"""CSV files with line ends inside quoted cells, read in byte ranges.

Spark splits a file into byte ranges only where a record cannot span lines. Here the lines are read split, and records are
found again by quote parity, in two passes:

1. The quotes of each byte range are counted (a map-side aggregation, one row per range); a window over the ranges of a file
   gives the parity at the start of each range. A line end is a record end when the quotes before it are even.
2. Each range walks its lines with that parity: records that start and end in the range are put together in the task. Only the
   pieces that cross a range's end travel: a tail (a record that starts in the range and goes on) and a head (lines before the
   range's first record start). A head belongs to the last tail of an earlier range of its file.

Records are then cut into cells by ``from_csv``. No file is read by one task, and only records that cross a range are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintlens.session import settled
from complaintlens.sources.complaints import NULL_TOKENS

PIECES = "file string, block long, kind int, seq long, text string"
# Kinds of pieces: lines before the first record start of a range, a record that goes on past the range, a whole record.
HEAD, TAIL, WHOLE = 0, 1, 2
# Most byte ranges whose start parity is broadcast; beyond, the lines are joined to it by a shuffle.
MAX_RANGES = 1_000_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lines of each range, in the order read: (file, block, kind, seq, text)."""
    where, parity, seq, lines, kind, start = None, 0, 0, [], HEAD, 0
    out = {"file": [], "block": [], "kind": [], "seq": [], "text": []}

    def emit(k: int, s: int) -> None:
        out["file"].append(where[0])
        out["block"].append(where[1])
        out["kind"].append(k)
        out["seq"].append(s)
        out["text"].append("\n".join(lines))

    for batch in batches:
        quotes = pc.count_substring(batch.column("line"), '"').to_pylist()
        for line, file, block, first_parity, q in zip(
            batch.column("line").to_pylist(), batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("parity").to_pylist(), quotes
        ):
            if (file, block) != where:
                if where is not None and lines:
                    emit(kind if kind == HEAD else TAIL, start)
                where, parity, seq, lines = (file, block), first_parity, 0, []
                kind, start = (HEAD, -1) if parity else (WHOLE, 0)
            if not lines and kind != HEAD:
                kind, start = WHOLE, seq
            lines.append(line)
            parity = (parity + q) % 2
            if parity == 0:
                emit(kind, start)
                lines, kind = [], WHOLE
            seq += 1
        if len(out["text"]) >= 4096:
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
            out = {name: [] for name in out}
    if where is not None and lines:
        emit(kind if kind == HEAD else TAIL, start)
    if out["text"]:
        yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("text", pa.string())])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text): each record of the CSV files at ``path`` as text, line ends inside cells kept."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    quotes = F.length("line") - F.length(F.regexp_replace("line", '"', ""))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int").alias("parity"))
    starts, small = settled(starts, "csv-range-parity", MAX_RANGES)
    if small:
        placed = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    pieces = placed.select("line", "file", "block", "parity").mapInArrow(_walk, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "seq", "text")
    # Heads belong to the last tail before them in their file; a range without a record start is all head.
    crossing = pieces.where(F.col("kind") != WHOLE)
    earlier = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct(F.col("block").alias("b"), F.col("seq").alias("s"))), ignorenulls=True).over(earlier)
    owned = crossing.withColumn("owner", owner)
    joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"))
    crossed = joined.select("file", F.col("owner.b").alias("block"), F.col("owner.s").alias("seq"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(crossed)


def read_csv_split(spark: SparkSession, path: str, columns: Sequence[str], null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """The rows of the CSV files at ``path`` (header first in each file, quote and escape ``"``) as strings; cells in
    ``null_tokens`` are null.

    Like ``complaints.read_complaints_csv``, but every file is read in byte ranges by many tasks, line ends inside quoted
    cells included. Each file's header must have the names of ``columns`` in that order, and each row as many cells: the job
    fails otherwise. Blank lines between records are skipped; a record's closing carriage return is dropped.
    """
    found = records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", "")).where(F.col("text") != "")
    ddl = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = found.select(((F.col("block") == 0) & (F.col("seq") == 0)).alias("header"), F.from_csv("text", ddl, options).alias("r"))
    wrong = F.lit(False)
    for i, name in enumerate(columns):
        wrong = wrong | ~F.col(f"r.c{i}").eqNullSafe(F.lit(name))
    checked = parsed.where(F.when(F.col("header") & wrong, F.raise_error(F.lit(f"a header differs from {list(columns)}"))).otherwise(~F.col("header")))
    cells = [F.when(F.col(f"r.c{i}").isin(*null_tokens), F.lit(None)).otherwise(F.col(f"r.c{i}")).alias(name) for i, name in enumerate(columns)]
    return checked.select(*cells)
