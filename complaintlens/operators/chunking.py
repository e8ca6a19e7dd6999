"""Overlapping chunks of narratives.

The splitting itself is a scalar Arrow UDF from a text to its list of pieces. Numbering
and ids come from ``posexplode`` and ``size``, so chunking is narrow: no shuffle, and it
works on streams too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintlens.functions.batches import text_slices
from complaintlens.functions.text import has_text

# Sizes in characters and the separators, in order of preference.
DEFAULT_CHUNK_SIZE = 500
DEFAULT_CHUNK_OVERLAP = 50
DEFAULT_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that each begin with the separator before them; characters for the empty one."""
    if not separator:
        return list(text)
    # A zero-width split in front of every separator keeps it with the text that follows.
    ends = [found.start() for found in re.finditer(re.escape(separator), text)]
    starts = [0, *ends]
    return [text[a:b] for a, b in zip(starts, [*ends, len(text)]) if a < b]


def _pack(pieces: Iterable[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined to chunks of up to ``size``, sharing up to ``overlap``."""
    pieces = list(pieces)
    chunks: list[str] = []
    first = 0
    length = 0
    for position, piece in enumerate(pieces):
        if first < position and length + len(piece) > size:
            chunks.append("".join(pieces[first:position]).strip())
            while first < position and (length > overlap or length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    chunks.append("".join(pieces[first:]).strip())
    return [chunk for chunk in chunks if chunk]


def split_text(
    text: str,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    separators: Sequence[str] = DEFAULT_SEPARATORS,
) -> list[str]:
    """Chunks of one text.

    The text is cut at the first separator that occurs in it. Runs of pieces below ``size``
    are packed; a piece that is not below it is cut further by the separators that follow.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    run: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        chunks += _pack(run, size, overlap)
        run = []
        chunks += split_text(piece, size, overlap, finer) if finer else [piece]
    return chunks + _pack(run, size, overlap)


def splitter(
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    separators: Sequence[str] = DEFAULT_SEPARATORS,
) -> Callable[[Column], Column]:
    """A column function from text to ``array<string>``; blank and null give an empty array."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"need size >= 1 and 0 <= overlap < size, got {size} and {overlap}")
    separators = tuple(separators)

    @F.arrow_udf("array<string>")
    def pieces(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            for some in text_slices(texts):
                lists = [
                    split_text(text, size, overlap, separators) if text and text.strip() else []
                    for text in some.to_pylist()
                ]
                yield pa.array(lists, pa.list_(pa.string()))

    return pieces


def chunk_documents(
    df: DataFrame,
    text_col: str,
    id_col: str,
    metadata_cols: Sequence[str] = (),
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int = DEFAULT_CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: chunk_id, complaint_id, chunk_index, total_chunks, chunk_text, metadata."""
    split = splitter(chunk_size, chunk_overlap)
    listed = df.filter(has_text(F.col(text_col))).select(
        F.col(id_col).alias("complaint_id"),
        *[F.col(c) for c in metadata_cols],
        split(F.col(text_col)).alias("_chunks"),
    )
    # A plain explode would bring a filter on the size of the list, which is pushed below and cuts every text once more.
    exploded = listed.select(
        "*", F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text")
    )
    return exploded.filter(F.col("chunk_index").isNotNull()).select(
        F.concat_ws("_", "complaint_id", "chunk_index").alias("chunk_id"),
        "complaint_id",
        "chunk_index",
        "total_chunks",
        "chunk_text",
        *metadata_cols,
    )


def chunk_stats(chunks: DataFrame, sample: DataFrame) -> DataFrame:
    """Number of chunks, of sampled complaints (those without text included), and the ratio."""
    n_chunks = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.lit(0).cast("long").alias("n_complaints"))
    n_complaints = sample.agg(
        F.lit(0).cast("long").alias("n_chunks"), F.count(F.lit(1)).alias("n_complaints")
    )
    return (
        n_chunks.unionByName(n_complaints)
        .agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_complaints").alias("n_complaints"))
        .withColumn("chunks_per_complaint", F.try_divide("n_chunks", "n_complaints"))
    )
