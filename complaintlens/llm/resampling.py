"""Importance resampling towards a target distribution, with features found by an Aho-Corasick automaton.

A feature is a run of 1 to ``max_words`` consecutive words, joined by one space, and falls into the bucket of its CRC-32
modulo ``buckets``. In each Arrow batch the distinct words of the batch become keys of an automaton, each bounded by a
delimiter on both sides and carrying its CRC and UTF-8 length as payload. One scan of a text emits the payloads of its words in
order; the CRC of a run of words is composed from those of its words (CRC of a concatenation from the parts and the length of the
second), so no feature string is built. A text leaves its task as one row: its counts per bucket.

Spark sums the counts per bucket (map-side, at most ``buckets`` rows), for the documents and for the target texts. The gain of a
bucket is the floored log ratio of its smoothed shares; the gains travel with the tasks as an array of ``buckets`` entries, so the
weight of a document is computed on its own row, without a join. Scores add a Gumbel key from a hash of the id, and the draw is a distributed sort
whose ranks come from per-partition counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.session import written_once

# Characters that part words after A-Z were lower-cased: ASCII that is neither digit nor lower-case letter.
DELIMITERS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_ZEROS: dict[int, int] = {}
SPACE_CRC = zlib.crc32(b" ")

FEATURES = "rid long, n_words long, n_features long, buckets array<int>, counts array<long>"


def crc_concat(first: int, second: int, second_length: int) -> int:
    """CRC-32 of the concatenation of two byte strings, from their CRCs and the length of the second.

    CRC-32 is affine in the message: crc(a + b) = crc(a + zeros) ^ crc(zeros) ^ crc(b), zeros as long as b.
    """
    zeros = b"\0" * second_length
    if second_length not in _ZEROS:
        _ZEROS[second_length] = zlib.crc32(zeros)
    return zlib.crc32(zeros, first) ^ _ZEROS[second_length] ^ second


def words_of(text: str | None) -> list[str]:
    """The plain split: words of ``text`` with A-Z lower-cased (for tests and for building the automaton's keys)."""
    return [w for w in DELIMITERS.split((text or "").translate(LOWER)) if w]


def _automaton(texts: list[str]) -> tuple[ahocorasick.Automaton | None, np.ndarray, np.ndarray]:
    """Keys ' word ' for each distinct word of ``texts`` (already spaced); payload: the word's number, with CRC and length."""
    vocabulary = sorted({w for t in texts for w in t.split(" ") if w})
    if not vocabulary:
        return None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    crcs, lengths = np.empty(len(vocabulary), np.uint32), np.empty(len(vocabulary), np.int64)
    for number, word in enumerate(vocabulary):
        raw = word.encode("utf-8")
        crcs[number], lengths[number] = zlib.crc32(raw), len(raw)
        automaton.add_word(f" {word} ", number)
    automaton.make_automaton()
    return automaton, crcs, lengths


def feature_counts(texts: list[str | None], max_words: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per text: number of words, number of features, buckets that occur and their counts."""
    spaced = [" " + DELIMITERS.sub(" ", (t or "").translate(LOWER)).strip(" ") + " " for t in texts]
    automaton, crcs, lengths = _automaton(spaced)
    for text in spaced:
        found = np.fromiter((number for _, number in automaton.iter(text)), np.int64) if automaton is not None and len(text) > 2 else np.zeros(0, np.int64)
        n = len(found)
        parts = [crcs[found].astype(np.int64)]
        running = list(parts[0])
        for width in range(2, max_words + 1):
            # Runs of ``width`` words: the run of ``width - 1`` words, a space, and the next word.
            running = [crc_concat(crc_concat(running[i], SPACE_CRC, 1), int(crcs[found[i + width - 1]]), int(lengths[found[i + width - 1]])) for i in range(n - width + 1)]
            if not running:
                break
            parts.append(np.array(running, np.int64))
        every = np.concatenate(parts) % buckets if n else np.zeros(0, np.int64)
        kinds, counts = np.unique(every, return_counts=True)
        yield n, len(every), kinds.astype(np.int32), counts.astype(np.int64)


def _features(rows: DataFrame, text_col: str, max_words: int, buckets: int) -> DataFrame:
    """(rid, n_words, n_features, buckets, counts) for each row of ``rows`` (rid, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(feature_counts(batch.column(text_col).to_pylist(), max_words, buckets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.int32())),
                    pa.array([f[3] for f in found], pa.list_(pa.int64())),
                ],
                names=["rid", "n_words", "n_features", "buckets", "counts"],
            )

    return rows.select("rid", text_col).mapInArrow(scan, FEATURES)


def _bucket_totals(features: DataFrame) -> DataFrame:
    pairs = features.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("c"))


def gains(docs_totals: DataFrame, target_totals: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket: floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))), in doubles (B buckets)."""
    s = {r.bucket: r.c for r in docs_totals.collect()}  # at most ``buckets`` rows
    t = {r.bucket: r.c for r in target_totals.collect()}
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    return [
        math.floor(1000 * math.log(((t.get(b, 0) + 1.0) * (big_s + buckets)) / ((s.get(b, 0) + 1.0) * (big_t + buckets)))) for b in range(buckets)
    ]


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_words: int = 1,
    buckets: int = 10_000,
    share_percent: int = 10,
    min_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """Every row of ``docs``: id, n_features, weight, score, rank (all long; rank null unless drawn).

    Features are runs of 1 to ``max_words`` words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z),
    repeats counted; null texts have none. weight is the floored mean gain of a row's features (0 without features).
    score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256 of ``seed:id`` (a null id gives
    ``seed:``). Of the N rows with at least ``min_words`` words, the floor(share_percent * N / 100) highest scores are drawn
    and ranked from 1; ties go to the smaller id, null ids last, then to the smaller row mark. Repeated rows are scored and
    drawn each on its own. An empty target makes every target share 1 / B. Other columns are left out.
    """
    rows = written_once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("rid", F.monotonically_increasing_id()), "resample-rows")
    features = written_once(_features(rows, "text", max_words, buckets), "resample-features")
    wanted = _features(target.select(F.col(target_text_col).alias("text")).withColumn("rid", F.lit(0).cast("long")), "text", max_words, buckets)
    weighed = _weights(features, np.array(gains(_bucket_totals(features), _bucket_totals(wanted), buckets), np.int64))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = rows.select("rid", "id").join(weighed, "rid")
    scored = written_once(scored.withColumn("score", F.col("weight") + gumbel), "resample-scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    draws = (share_percent * eligible.count()) // 100
    ranked = _ranks(eligible.select("rid", "score", "id"), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid")], draws)
    out = scored.join(ranked, "rid", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _weights(features: DataFrame, table: np.ndarray) -> DataFrame:
    """(rid, n_words, n_features, weight): the floored mean gain of a row's features, 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, counts, sizes = batch.column("buckets").to_pylist(), batch.column("counts").to_pylist(), batch.column("n_features").to_pylist()
            weight = [math.floor(int(np.dot(table[k], c)) / n) if n else 0 for k, c, n in zip(kinds, counts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())],
                names=["rid", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(weigh, "rid long, n_words long, n_features long, weight long")


def _ranks(rows: DataFrame, order: list, most: int) -> DataFrame:
    """(rid, rank) of the first ``most`` rows of ``rows`` in ``order``: a range-partitioned sort, ranks from per-partition counts."""
    if most <= 0:
        return rows.select("rid", F.lit(None).cast("long").alias("rank")).limit(0)
    placed = written_once(
        rows.orderBy(*order).select("rid", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")), "resample-sorted"
    )
    # One row per partition of the sort.
    counts = sorted((r.pid, r.n, r.low) for r in placed.groupBy("pid").agg(F.count("*").alias("n"), F.min("mid").alias("low")).collect())
    before, offsets = 0, []
    for pid, n, low in counts:
        offsets.append((pid, before, low))
        before += n
    starts = placed.sparkSession.createDataFrame(offsets, "pid int, before long, low long")
    rank = F.col("before") + F.col("mid") - F.col("low") + 1
    return placed.join(F.broadcast(starts), "pid").select("rid", rank.alias("rank")).where(F.col("rank") <= most)
