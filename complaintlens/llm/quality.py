"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.llm import boosting
from complaintlens.llm.beside import map_beside
from complaintlens.llm.labelled import remainder, training_ids

SYMBOLS = b"#*$%&|<>!?.,;:-_"
FEATURES = 18 + len(SYMBOLS)


def statistics(text: str | None) -> np.ndarray:
    """``FEATURES`` numbers of a whole text; all 0 for null and empty texts."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, letters = len(raw), max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    times = np.bincount(ids)
    times.sort()
    pairs = np.unique(ids[1:] * n + ids[:-1]).size if n > 1 else 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    out[:18] = (
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), lengths.max(),
        counts[65:91].sum() / letters, letters / size, counts[48:58].sum() / size, counts[128:].sum() / size, counts[:32].sum() / size,
        len(known) / n, times[-1] / n, times[-5:].sum() / n, (ids[1:] == ids[:-1]).sum() / n, pairs / max(1, n - 1),
        len(lines) / n, 1 - len(set(lines)) / len(lines), len(known) / np.sqrt(n),
    )
    out[18:] = counts[np.frombuffer(SYMBOLS, np.uint8)] / n
    return out


def _statistics_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": [statistics(t).tolist() for t in batch["text"]]})


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int, max_per_class: int) -> boosting.Forest:
    """Trees fitted on at most ``max_per_class`` labelled documents of each class outside the held-out fold."""
    ids = training_ids(labels, id_col, label_col, folds, held_out, max_per_class)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.mapInPandas(_statistics_rows, f"id {id_type}, label int, x array<double>")
    # Ids may repeat in the documents: no more rows than ids come to the driver.
    found = rows.orderBy(F.xxhash64("id"), "id", "x").limit(2 * max_per_class).toArrow()
    x = np.array(found["x"].to_pylist(), dtype=float).reshape(-1, FEATURES)
    return boosting.fit(x, np.array(found["label"].to_pylist(), dtype=float))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2,
    max_per_class: int = 6000, threshold: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, score (0 to 1, higher if label 1 is likelier), predicted.

    Trees are fitted on rows of ``labels`` (``id_col``, ``label_col``) outside the fold that is held out; ``max_per_class`` bounds
    them. Scores use the text alone. Null and empty texts have statistics of 0 and are scored like others; with labels of one
    class or none all scores are the same. Repeated rows give repeated results, other columns are left out, an empty table gives
    an empty result.
    """
    forest = fit_quality(docs, labels, id_col, text_col, label_col, folds, held_out, max_per_class)

    def judge(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = np.array([statistics(t) for t in batch["text"]]).reshape(-1, FEATURES)
        score = forest.score(x)
        yield pd.DataFrame({"score": score, "predicted": (score >= threshold).astype("int32")})

    rows = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return map_beside(rows, ["id", "held_out"], judge, "score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2,
    max_per_class: int = 6000, threshold: float = 0.7,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_quality`` would predict as 1. No shuffle: rows are judged where they are."""
    forest = fit_quality(docs, labels, id_col, text_col, label_col, folds, held_out, max_per_class)

    # In Arrow, as pandas would round whole numbers beside a null.
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(text_col).to_pylist()]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(forest.score(x) >= threshold))

    return docs.mapInArrow(judge, docs.schema)
