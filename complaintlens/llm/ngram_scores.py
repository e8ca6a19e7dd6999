"""Stupid-backoff scores of documents under bigram counts of the whole corpus.

The score of a word after another is count(pair) / count(pairs with that first word) if the pair is in the table, that
is, seen at least ``min_count`` times, and else ``backoff`` times count(pairs with that second word) / count(all pairs). A
text starts with a start sign as its first word.

Texts are cut into words by Arrow in the tasks; counting, looking up and summing are Spark's shuffles, windows and joins. Words are
counted as firsts and as seconds per slice of texts and summed. Up to ``hot_words`` most frequent words are held by the driver (a list
of bounded length) and travel with the tasks as numbers, and so do up to ``hot_pairs`` of their pairs that are frequent in some slice,
counted exactly in a pass of their own, so a pair that a third of the corpus uses stays with its texts. What is left falls in two:

* Pairs of two hot words are dealt once by one whole number to hash partitions of about ``grams_per_part`` pairs, where a window counts
  them. A text begins with the score its pairs would have outside the table, and only pairs in the table send a correction back.
* A pair with another word is dealt by that whole word to where the word's counts are joined, and a window counts it there. A pair
  of two such words goes to both: the first's place scores it if it is in the table, the second's if it is not.

Logarithms are summed as whole numbers (``SCALE`` per unit), so the order of the sum does not change a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.functions.batches import text_slices
from complaintlens.session import scratch_dir, written_once

HOT_WORDS, HOT_PAIRS = 1 << 18, 1 << 16
# A pair is looked at as a frequent one if a slice of texts has it so often.
OFTEN = 8
SLICE_BYTES = 8 * 1024 * 1024
SCALE = 1 << 24
# Stands for the word before the first: words never hold white space.
START = " "
# A hot word's number fits in so many bits.
_BITS = 20


class Hot(NamedTuple):
    """Hot words in order of their numbers (``START`` is 0) with their scores outside the table; the keys of frequent pairs in order and their scores."""

    words: pa.Array
    unknown: np.ndarray
    keys: np.ndarray
    scores: np.ndarray


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and the number of each text's words. Only A-Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    return words.filter(full), np.bincount(rows.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts))


def _before(numbers: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The number of the word before each word, ``start`` before the first of a text."""
    before = np.concatenate([[start], numbers[:-1]])[: len(numbers)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return before


def _numbered(texts: pa.Array, hot: Hot) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the number of each (-1: not hot) and of the one before it, and the number of each text's words."""
    words, sizes = cut(texts)
    numbers = pc.fill_null(pc.index_in(words, value_set=hot.words), -1).to_numpy(zero_copy_only=False).astype("int64")
    return words, numbers, _before(numbers, sizes, 0), sizes


def _keys(hot: Hot, before: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair's key (below zero: a word of it is not hot), its place among the frequent pairs, and whether it is one of them."""
    keys = np.where((before < 0) | (numbers < 0), -1, (before << _BITS) + numbers)
    place = np.searchsorted(hot.keys, keys)
    place[place == len(hot.keys)] = 0
    return keys, place, hot.keys[place] == keys if len(hot.keys) else np.zeros(len(keys), bool)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of (rid, text) in slices, with their texts."""
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column("text"), SLICE_BYTES):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def _counted(texts: DataFrame) -> DataFrame:
    """(word, next, n_first, n_second): how many pairs have the word as their first and as their second. Rows with ``next`` are pairs
    that are frequent in a slice, with their number there as n_first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _slices(batches):
            words, sizes = cut(part)
            coded = words.cast(pa.string()).dictionary_encode()
            # The start sign takes 0, the slice's words follow.
            names = pa.concat_arrays([pa.array([START]), coded.dictionary])
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("int64") + 1
            before = _before(codes, sizes, 0)
            counts = [np.bincount(c, minlength=len(names)) for c in (before, codes)]
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), *map(pa.array, counts)], ["word", "next", "n_first", "n_second"])
            pairs, times = np.unique(before * len(names) + codes, return_counts=True)
            pairs, times = pairs[times >= OFTEN], times[times >= OFTEN]
            a, b = (names.take(pa.array(x)) for x in np.divmod(pairs, len(names)))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(times), pa.array(np.zeros_like(times))], ["word", "next", "n_first", "n_second"])

    found = texts.select("text").mapInArrow(count, "word string, next string, n_first long, n_second long")
    sums = found.groupBy("word", "next").agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))
    return sums.filter(F.col("n_first") + F.col("n_second") > 0)


def _least(df: DataFrame, n: Column, most: int) -> int:
    """The smallest count that at most ``most`` rows of ``df`` reach."""
    told = df.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).toArrow()
    n, rows = (told.column(c).to_numpy() for c in ("n", "rows"))
    taken = int((np.cumsum(rows) <= most).sum())
    return int(n[taken - 1]) if taken else int(n[0]) + 1 if len(n) else 1


def _known(n_both: Column, n_first: Column) -> Column:
    """The score of a pair in the table, as a whole number."""
    return F.round(F.lit(float(SCALE)) * (F.log(n_both.cast("double")) - F.log(n_first.cast("double")))).cast("long")


def _unknown(n_second: Column, backoff: float, total: int) -> Column:
    """The score of a pair outside the table, as a whole number."""
    score = (F.log(F.lit(float(backoff))) + F.log(n_second.cast("double"))) - F.log(F.lit(float(max(total, 1))))
    return F.round(F.lit(float(SCALE)) * score).cast("long")


def _frequent(texts: DataFrame, hot: Hot, candidates: pa.Table, n_first: np.ndarray, min_count: int) -> Hot:
    """``hot`` with the candidate pairs of two hot words, counted over all texts, that are in the table."""
    a, b = (pc.index_in(candidates.column(c).combine_chunks(), value_set=hot.words) for c in ("word", "next"))
    both = pc.and_(a.is_valid(), b.is_valid())
    a, b = (x.filter(both).to_numpy(zero_copy_only=False).astype("int64") for x in (a, b))
    hot = hot._replace(keys=np.sort((a << _BITS) + b))
    if not len(hot.keys):
        return hot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(hot.keys), "int64")
        for _, part in _slices(batches):
            _, numbers, before, _ = _numbered(part, hot)
            _, place, found = _keys(hot, before, numbers)
            times += np.bincount(place[found], minlength=len(times))
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(hot.keys[at]), pa.array(n_first[hot.keys[at] >> _BITS]), pa.array(times[at])], ["key", "n_first", "n"])

    counted = texts.select("text").mapInArrow(count, "key long, n_first long, n long")
    counted = counted.groupBy("key", "n_first").agg(F.sum("n").alias("n_both")).filter(F.col("n_both") >= min_count)
    told = counted.select("key", _known(F.col("n_both"), F.col("n_first")).alias("s")).toArrow().sort_by("key")
    return hot._replace(keys=told.column("key").to_numpy(), scores=told.column("s").to_numpy())


def _beginnings(hot: Hot):
    """A column function from text to its number of words and the scores of its pairs of hot words, as if none but the frequent were in the table."""

    @F.arrow_udf("struct<n_words: long, s: long>")
    def begin(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (some for part in parts for some in text_slices(part, SLICE_BYTES)):
            _, numbers, before, sizes = _numbered(texts, hot)
            keys, place, frequent = _keys(hot, before, numbers)
            scores = np.where(keys >= 0, hot.unknown[numbers], 0)
            scores[frequent] = hot.scores[place[frequent]]
            ends = np.concatenate([[0], np.cumsum(scores)])[np.cumsum(sizes)]
            yield pa.StructArray.from_arrays([pa.array(sizes.astype("int64")), pa.array(np.diff(ends, prepend=0).astype("int64"))], ["n_words", "s"])

    return begin


def _hot_pairs(texts: DataFrame, hot: Hot) -> DataFrame:
    """(rid, key): a row per pair of two hot words that is not a frequent one."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in _slices(batches):
            _, numbers, before, sizes = _numbered(part, hot)
            keys, _, frequent = _keys(hot, before, numbers)
            left = (keys >= 0) & ~frequent
            rids = np.repeat(rows.column("rid").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rids[left]), pa.array(keys[left])], ["rid", "key"])

    return texts.mapInArrow(pairs, "rid long, key long")


def _cold_pairs(texts: DataFrame, hot: Hot) -> DataFrame:
    """(rid, word, first, i, other): a row per pair and word of it that is not hot, but only that of the second if the first is hot. ``first``: the word is the
    first of the pair; the other one is given by its number or, if it is not hot either, as it is."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in _slices(batches):
            words, numbers, before, sizes = _numbered(part, hot)
            rids = np.repeat(rows.column("rid").to_numpy(), sizes)
            for first, mine, others, step in ((False, numbers, before, 0), (True, before, numbers, -1)):
                at = np.flatnonzero(mine < 0)
                number = others[at]
                # A word before the first of a text is the start sign, which is hot: the word's neighbour is in the same text.
                other = words.take(pa.array(at + (0 if first else -1), mask=number >= 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[at]), words.take(pa.array(at + step)), pa.array(np.full(len(at), first)), pa.array(number, mask=number < 0), other],
                    ["rid", "word", "first", "i", "other"],
                )

    return texts.mapInArrow(pairs, "rid long, word string, first boolean, i long, other string")


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2, backoff: float = 0.4, grams_per_part: int = 4_000_000,
    hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, log_score (natural logarithm, summed), mean_log_score (per word).

    Counts are over all rows of ``docs``, repeated ones each time. Words are what stands between white space, with A-Z lower-cased.
    Null, empty and blank texts have no words and scores of 0. Null ids stay null, other columns are left out, an empty table
    gives an empty result. Very long texts and words are taken whole. A pair's score is rounded to 1 / ``SCALE`` before it is
    summed.
    """
    spark = docs.sparkSession
    # Numbered once and stored, so that every pass over the texts sees the same rows under the same numbers.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    path = scratch_dir(spark, "lm-texts")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    texts = rows.select("rid", "text")
    counts = written_once(_counted(texts), "lm-words")
    words, candidates = counts.filter(F.col("next").isNull()).drop("next"), counts.filter(F.col("next").isNotNull())
    total = words.agg(F.sum("n_second")).first()[0] or 0
    parts = max(1, -(-total // grams_per_part))
    times = F.col("n_first") + F.col("n_second")
    is_hot = (times >= _least(words, times, min(hot_words, (1 << _BITS) - 1))) | (F.col("word") == START)

    told = words.filter(is_hot).withColumn("s", F.when(F.col("n_second") > 0, _unknown(F.col("n_second"), backoff, total)).otherwise(0))
    told = told.withColumn("later", F.col("word") != START).toArrow().sort_by([("later", "ascending"), ("word", "ascending")])
    n_first, unknown = (told.column(c).to_numpy() for c in ("n_first", "s"))
    hot = Hot(told.column("word").combine_chunks(), unknown, np.zeros(0, "int64"), np.zeros(0, "int64"))
    if hot_pairs > 0:
        often = candidates.filter(F.col("n_first") >= _least(candidates, F.col("n_first"), hot_pairs)).select("word", "next").toArrow()
        hot = _frequent(texts, hot, often, n_first, min_count)

    table = pa.table({"i": np.arange(len(unknown)), "n_first": n_first, "n_second": told.column("n_second"), "s": unknown})
    held = spark.createDataFrame(table, "i long, n_first long, n_second long, s long")
    firsts = F.broadcast(held.select("i", F.col("n_first").alias("hot_first"), F.col("s").alias("hot_unknown")))
    seconds = F.broadcast(held.select(F.col("i").alias("bi"), F.col("s").alias("before")))

    dealt = _hot_pairs(texts, hot).repartition(parts, "key")
    same = dealt.withColumn("n_both", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter(F.col("n_both") >= min_count)
    same = same.withColumns({"i": F.shiftright("key", _BITS), "bi": F.col("key").bitwiseAND((1 << _BITS) - 1)}).join(firsts, "i").join(seconds, "bi")
    corrections = same.select("rid", (_known(F.col("n_both"), F.col("hot_first")) - F.col("before")).alias("s"))

    cold = _cold_pairs(texts, hot).repartition(parts, "word").join(words.filter(~is_hot).repartition(parts, "word"), "word")
    cold = cold.withColumn("n_both", F.count(F.lit(1)).over(Window.partitionBy("word", "first", "i", "other"))).join(firsts, "i", "left")
    known = _known(F.col("n_both"), F.when(F.col("first"), F.col("n_first")).otherwise(F.col("hot_first")))
    other = F.when(F.col("first"), F.col("hot_unknown")).otherwise(_unknown(F.col("n_second"), backoff, total))
    # Null where the pair's other word, not hot either, has the count: the pair's other row has the score.
    cold = cold.select("rid", F.when(F.col("n_both") >= min_count, known).otherwise(other).alias("s")).filter(F.col("s").isNotNull())

    sums = corrections.unionByName(cold).groupBy("rid").agg(F.sum("s").alias("more"))
    out = rows.select("rid", "id", _beginnings(hot)(F.col("text")).alias("begun")).join(sums, "rid", "left")
    n_words = F.col("begun.n_words")
    log_score = (F.col("begun.s") + F.coalesce(F.col("more"), F.lit(0))).cast("double") / SCALE
    out = out.select(F.col("id").alias(id_col), n_words.alias("n_words"), log_score.alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0)))
