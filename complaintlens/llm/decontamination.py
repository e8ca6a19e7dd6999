"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

An item is found in a text if a window of as many words is similar: the weighted Jaccard similarity of their word
shingles reaches a threshold. Similarity counts shared shingles only, so a window can be moved to its first shared
shingle without loss, and windows are taken just there. Windows and items get a SimHash fingerprint. Fingerprints are
cut into blocks; two within ``radius`` bits agree in one block up to ``radius // blocks`` bits, so items are stored under
all block values that near and windows look up their own. What is found within the radius is compared exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintlens.llm.words import alphanumeric_words, explode_grams, gram_hash
from complaintlens.session import local_if_small, written_once

BITS, LANES = 64, 32  # a counter of 32 bits for every 32nd bit of a hash, two to a long


def _fingerprint(grams: DataFrame, keys: list[str], hash_col: str, weight_col: str) -> DataFrame:
    """``keys`` and ``fp``: a bit is 1 if over half the weight of the hashes has it.

    Counters hold up to 2^31 - 1 weighted hashes a key, so windows and items of up to two billion words.
    """
    mask = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(hash_col, j).bitwiseAND(mask) * F.col(weight_col)).alias(f"lane{j}") for j in range(LANES)]
    summed = grams.groupBy(*keys).agg(*sums, F.sum(weight_col).alias("weight"))

    def bit(i: int) -> Column:
        lane, field = i % LANES, i // LANES
        count = F.shiftrightunsigned(f"lane{lane}", 32 * field).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * count > F.col("weight"), F.lit(1 << i if i < BITS - 1 else -(1 << (BITS - 1)))).otherwise(F.lit(0).cast("long"))

    # The union of the 64 bits, as a balanced tree of ORs: a shallow expression keeps planning cheap for the driver.
    parts = [bit(i) for i in range(BITS)]
    while len(parts) > 1:
        parts = [parts[j].bitwiseOR(parts[j + 1]) if j + 1 < len(parts) else parts[j] for j in range(0, len(parts), 2)]
    return summed.select(*keys, parts[0].alias("fp"))


def _blocks(fp: Column, blocks: int, variants: list[int]) -> Column:
    """An array of (block, value), for each block of a fingerprint and each of ``variants`` to flip in it."""
    size = BITS // blocks
    values = [
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, b * size).bitwiseAND(F.lit((1 << size) - 1)).bitwiseXOR(F.lit(v)).alias("value"))
        for b in range(blocks) for v in variants
    ]
    return F.array(*values)


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a join: held and broadcast if it is small, else as it is."""
    held = local_if_small(df)
    return df if held is None else F.broadcast(held)


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 23, blocks: int = 8,
) -> DataFrame:
    """One row per document and item found in it: ``id_col``, ``item_id_col``, first_word, n_words, similarity, hamming.

    The row is of the most similar window, of the first among equals; ``first_word`` counts from 0 and ``n_words`` is the length of the
    item. Words are runs of digits, letters and characters outside ASCII, case aside; items of fewer than ``shingle`` words are one
    shingle, items without words are never found, and in a text shorter than the item the window is the whole text. Null texts
    are empty. Repeated documents and items (same id and text) count once; null ids stay null. Other columns are left out; an
    empty table on either side gives an empty result.
    """
    best = _best_windows(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, similarity, radius, blocks)
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_id_col), F.col("b.first_word").cast("long").alias("first_word"), F.col("b.n_words").cast("long").alias("n_words"),
        (-F.col("b.col1")).alias("similarity"), "b.hamming",
    )


def drop_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 23, blocks: int = 8,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose own text ``find_items`` finds nothing.

    A row goes by its id and text, so clean rows that share an id, or have none, stay.
    """
    best = _best_windows(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, similarity, radius, blocks)
    found = best.select(F.col("ids").alias("__ids"), F.col("th").alias("__th")).distinct()
    same = (_id_text(id_col) == F.col("__ids")) & (F.xxhash64(text_col) == F.col("__th"))
    return docs.join(found, same, "left_anti")


def _id_text(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _best_windows(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, shingle: int, similarity: float, radius: int, blocks: int
) -> DataFrame:
    """(ids, th, key, id, item, b): per document (id as text, hash of the text) and item the most similar window."""
    words = docs.select(F.col(id_col).alias("id"), _id_text(id_col).alias("ids"), F.xxhash64(text_col).alias("th"), alphanumeric_words(F.col(text_col)).alias("words"))
    wanted = items.select(F.col(item_id_col).alias("item"), F.xxhash64(item_id_col, item_text_col).alias("key"), alphanumeric_words(F.col(item_text_col)).alias("words"))
    wanted = wanted.filter(F.size("words") > 0).dropDuplicates(["key"]).withColumn("size", F.size("words")).withColumn("k", F.least("size", F.lit(shingle)))
    wanted = written_once(wanted, "benchmark-items")
    parts = [_found(words, wanted.filter(F.col("k") == k), k, similarity, radius, blocks) for k in sorted(row["k"] for row in wanted.select("k").distinct().collect())]
    if not parts:
        parts = [_found(words, wanted, shingle, similarity, radius, blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("ids", "th", "key").agg(F.first("id").alias("id"), F.first("item").alias("item"), F.min(F.struct(-F.col("similarity"), "first_word", "n_words", "hamming")).alias("b"))


def _grams(df: DataFrame, words: str, k: int, *keep: str) -> DataFrame:
    """Whole k-grams only: ``keep``, pos, hash, shingle."""
    grams = explode_grams(df, words, k, *keep).filter(F.col(f"gram.w{k - 1}").isNotNull())
    return grams.select(*keep, "pos", gram_hash(F.col("gram"), k).alias("hash"), F.concat_ws(" ", *[f"gram.w{j}" for j in range(k)]).alias("shingle"))


def _found(words: DataFrame, items: DataFrame, k: int, similarity: float, radius: int, blocks: int) -> DataFrame:
    item_grams = _grams(items, "words", k, "key", "size").groupBy("key", "size", "hash", "shingle").agg(F.count("*").alias("count"))
    text, window = ["ids", "th"], ["ids", "th", "size", "start"]

    # Shared shingles, and the windows that begin there.
    grams = _grams(words.withColumn("n", F.size("words")), "words", k, "id", *text, "n")
    shared = grams.join(_small(item_grams.select("key", "size", "hash", F.col("shingle").alias("same"))), "hash").filter(F.col("shingle") == F.col("same"))
    shared = shared.groupBy("id", *text, "key", "size", "n").agg(F.collect_set("pos").alias("places"))
    # So many of the item's shingles must be shared for the similarity.
    needed = F.ceil(similarity / (1 + similarity) * ((F.col("size") - k + 1) + (F.least("size", "n") - k + 1)) - 1e-9)
    starts = shared.filter(F.size("places") >= needed).withColumn("place", F.explode("places"))
    starts = starts.select("id", *text, F.col("size").alias("size"), F.least("place", F.greatest(F.col("n") - F.col("size"), F.lit(0))).alias("start"))
    per_text = starts.groupBy(*text).agg(F.collect_set(F.struct("size", "start")).alias("windows"))

    cut = words.join(per_text, text).dropDuplicates(text).select("id", *text, "words", F.explode("windows").alias("w"))
    cut = cut.select("id", *text, "w.size", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.size")).alias("part"))
    weighted = _grams(cut, "part", k, "id", *window).groupBy(*window, "hash", "shingle").agg(F.first("id").alias("id"), F.count("*").alias("weight"))
    weighted = written_once(weighted, "benchmark-windows")

    # Fingerprints that meet in a block.
    flips = [sum(1 << i for i in chosen) for near in range(radius // blocks + 1) for chosen in combinations(range(BITS // blocks), near)]
    item_marks = _fingerprint(item_grams, ["key", "size"], "hash", "count")
    stored = item_marks.select("key", "size", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), blocks, flips)).alias("at"))
    asked = _fingerprint(weighted, window, "hash", "weight").select(*window, "fp", F.explode(_blocks(F.col("fp"), blocks, [0])).alias("at"))
    pairs = asked.join(_small(stored), ["size", "at"])
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("hamming") <= radius).select(*window, "key", "hamming").distinct()

    # Exact similarity of the pairs.
    sizes = item_grams.groupBy("key").agg(F.sum("count").alias("item_weight"), F.first("size").alias("n_words"))
    inside = weighted.groupBy(*window).agg(F.sum("weight").alias("window_weight"), F.first("id").alias("id"))
    both = pairs.join(weighted.drop("id"), window).join(_small(item_grams.select("key", "shingle", "count")), ["key", "shingle"])
    common = both.groupBy(*window, "key").agg(F.sum(F.least("weight", "count")).alias("common"), F.first("hamming").alias("hamming"))
    scored = common.join(inside, window).join(_small(sizes.join(items.select("key", "item"), "key")), "key")
    scored = scored.withColumn("similarity", F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common")))
    return scored.filter(F.col("similarity") >= similarity).select("id", *text, "key", "item", F.col("start").alias("first_word"), "n_words", "similarity", "hamming")
