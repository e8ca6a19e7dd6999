"""Reproducible stratified sampling.

Rows of a category are ranked by ``md5(seed:key)`` and the first ones kept, so the sample
is the same whatever the partitioning. No category is sorted for that: rows are counted per
category and slice of the hash range, which tells the slice in which a category reaches its
target; that slice is cut into finer ones until it holds few rows. Only keys and hashes of
those few are ranked, to find the last hash of the sample. The sample itself is a filter by
that hash in the scan; no row of full width is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.functions.text import round_even
from complaintlens.session import settled

DEFAULT_SLICES = 1024
# Rows of a category whose hashes are sorted in one task at most, unless hashes agree in 60 bits.
MAX_RANKED = 10_000
_HASH_BITS = 60


def sample_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to stratify by; found {df.columns}")


def _with_targets(counts: DataFrame, total: Column, target_n: int) -> DataFrame:
    """Adds ``share`` and ``target`` to one row per category with its count ``n``."""
    share = F.col("n") / total
    wanted = round_even(share * float(target_n)).cast("long")
    return counts.withColumn("share", share).withColumn("target", F.least(wanted, F.col("n")))


def stratified_targets(df: DataFrame, strat_col: str, target_n: int) -> DataFrame:
    """Rows to draw per non-null category: its share of ``target_n``, at most all it has."""
    _require(df, strat_col)
    counts, _ = settled(
        df.filter(F.col(strat_col).isNotNull())
        .groupBy(strat_col)
        .agg(F.count(F.lit(1)).alias("n")),
        "strata",
    )
    return _with_targets(counts, counts.agg(F.sum("n")).scalar(), target_n)


def stratified_sample(
    df: DataFrame,
    strat_col: str,
    target_n: int,
    key: str,
    seed: int = 42,
    shuffle: bool = False,
    slices: int | None = None,
    max_ranked: int | None = None,
    fanout: int = 8,
) -> DataFrame:
    """About ``target_n`` rows without replacement, in the proportions of ``strat_col``.

    ``key`` identifies a row; rows that share one are taken together, and rows without one are told
    apart by their content. With ``shuffle`` the sample comes in an order that the seed determines.
    All targets 0 give an empty frame.

    By default the last hash of each category is found by bottom-k lists (``bottom_k_sample``): two scans of key and
    category, then one filter. With ``slices`` or ``max_ranked`` it is found by counting slices of the hash range instead;
    both give the same rows.
    """
    if slices is None and max_ranked is None:
        return bottom_k_sample(df, strat_col, target_n, key, seed, shuffle, fanout)
    slices, max_ranked = slices or DEFAULT_SLICES, max_ranked or MAX_RANKED
    _require(df, strat_col)
    content = F.concat(F.lit("row "), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    hashed = df.filter(F.col(strat_col).isNotNull()).withColumn(
        "_hash", sample_hash(F.coalesce(F.col(key).cast("string"), content), seed)
    )
    hashed = hashed.withColumn("_at", F.conv(F.substring("_hash", 1, _HASH_BITS // 4), 16, 10).cast("long"))
    narrow = hashed.select(F.col(strat_col).alias("_stratum"), F.col(key).alias("_key"), "_hash", "_at")

    edges, small, width = None, True, 1 << _HASH_BITS
    while edges is None or (width > 1 and slices > 1 and not edges.filter(F.col("_rows") > max_ranked).isEmpty()):
        step = max(1, -(-width // slices))
        within = narrow if edges is None else _within(narrow, edges, small, width)
        base = F.lit(0) if edges is None else F.col("_low")
        counts, _ = settled(
            within.groupBy("_stratum", F.floor((F.col("_at") - base) / step).alias("_slice")).agg(F.count(F.lit(1)).alias("_rows")), "slices"
        )
        if edges is None:
            n = counts.groupBy("_stratum").agg(F.sum("_rows").alias("n"))
            targets = _with_targets(n, counts.agg(F.sum("_rows")).scalar(), target_n)
            edges = targets.select("_stratum", F.col("target").alias("_need"), F.lit(0).cast("long").alias("_low"))
        # A frame holds the counted slices of a category, at most ``slices`` rows.
        so_far = Window.partitionBy("_stratum").orderBy("_slice")
        reached = counts.withColumn("_upto", F.sum("_rows").over(so_far)).join(edges.select("_stratum", "_need", "_low"), "_stratum")
        reached = reached.filter((F.col("_need") > 0) & (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_rows") < F.col("_need")))
        edges, small = settled(
            reached.select("_stratum", (F.col("_need") - F.col("_upto") + F.col("_rows")).alias("_need"), (F.col("_low") + F.col("_slice") * step).alias("_low"), "_rows"), "edges"
        )
        width = step

    order = Window.partitionBy("_stratum").orderBy("_hash", "_key")
    last = _within(narrow, edges, small, width).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == F.col("_need"))
    last, small = settled(last.select("_stratum", F.col("_hash").alias("_last_hash"), F.col("_key").alias("_last_key")), "last")
    sample = hashed.join(F.broadcast(last) if small else last, F.col(strat_col) == F.col("_stratum"))
    same = (F.col("_hash") == F.col("_last_hash")) & F.coalesce(F.col(key) <= F.col("_last_key"), F.lit(True))
    sample = sample.filter((F.col("_hash") < F.col("_last_hash")) | same)
    if shuffle:
        sample = sample.orderBy("_hash", key)
    return sample.select(*[F.col(f"`{c}`") for c in df.columns])


def _narrow(df: DataFrame, strat_col: str, key: str, seed: int) -> DataFrame:
    """(_stratum, _key, _hash) of every row with a category; only rows without a key are read at full width."""
    keyed = df.filter(F.col(strat_col).isNotNull() & F.col(key).isNotNull())
    keyed = keyed.select(F.col(strat_col).alias("_stratum"), F.col(key).alias("_key"), sample_hash(F.col(key), seed).alias("_hash"))
    content = F.concat(F.lit("row "), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    unkeyed = df.filter(F.col(strat_col).isNotNull() & F.col(key).isNull())
    unkeyed = unkeyed.select(F.col(strat_col).alias("_stratum"), F.col(key).alias("_key"), sample_hash(content, seed).alias("_hash"))
    return keyed.unionByName(unkeyed)


def bottom_k_sample(df: DataFrame, strat_col: str, target_n: int, key: str, seed: int = 42, shuffle: bool = False, fanout: int = 8) -> DataFrame:
    """The rows of ``stratified_sample``, by bottom-k lists.

    One scan counts each category and gives its target. A second keeps, per task and category, the ``k`` smallest
    (hash, key) pairs, ``k`` the largest target (a partial window limit before the shuffle); those lists are merged in a
    tree, ``fanout`` tasks' lists at a time, each level keeping ``k`` per category, so no merge holds more than
    ``fanout * k`` rows of a category. The row at the target's rank is the last of the sample, and the sample is one filter
    of the table by it. Both scans read key and category only, unless keys are null.
    """
    _require(df, strat_col)
    narrow = _narrow(df, strat_col, key, seed)
    counts, _ = settled(narrow.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")), "strata")
    targets = _with_targets(counts, counts.agg(F.sum("n")).scalar(), target_n).select("_stratum", F.col("target").alias("_need")).filter("_need > 0")
    targets, small = settled(targets, "targets")
    k = targets.agg(F.max("_need")).first()[0]
    if not k:
        return df.limit(0)
    order = [F.col("_hash"), F.col("_key").asc_nulls_first()]
    level = narrow.join(F.broadcast(targets) if small else targets, "_stratum").withColumn("_group", F.spark_partition_id())
    groups = max(narrow.rdd.getNumPartitions(), 1)
    while groups > 1:
        level = level.withColumn("_group", F.floor(F.col("_group") / fanout))
        listed = Window.partitionBy("_stratum", "_group").orderBy(*order)
        level = level.withColumn("_r", F.row_number().over(listed)).filter(F.col("_r") <= k).drop("_r")
        groups = -(-groups // fanout)
    ranked = Window.partitionBy("_stratum").orderBy(*order)
    last = level.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).filter(F.col("_rank") == F.col("_need"))
    last, small = settled(last.select("_stratum", F.col("_hash").alias("_last_hash"), F.col("_key").alias("_last_key")), "last")
    hashed = df.filter(F.col(strat_col).isNotNull())
    content = F.concat(F.lit("row "), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    hashed = hashed.withColumn("_hash", sample_hash(F.coalesce(F.col(key).cast("string"), content), seed))
    sample = hashed.join(F.broadcast(last) if small else last, F.col(strat_col) == F.col("_stratum"))
    same = (F.col("_hash") == F.col("_last_hash")) & F.coalesce(F.col(key) <= F.col("_last_key"), F.lit(True))
    sample = sample.filter((F.col("_hash") < F.col("_last_hash")) | same)
    if shuffle:
        sample = sample.orderBy("_hash", key)
    return sample.select(*[F.col(f"`{c}`") for c in df.columns])


def _within(narrow: DataFrame, edges: DataFrame, small: bool, width: int) -> DataFrame:
    """The rows of each category from its ``_low`` on, ``width`` hashes wide."""
    joined = narrow.join(F.broadcast(edges) if small else edges, "_stratum")
    return joined.filter((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + F.lit(width)))


def sampling_summary(original: DataFrame, sample: DataFrame, strat_col: str) -> DataFrame:
    """Count and percentage of each category in the table and in the sample, side by side."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return (
            df.filter(F.col(strat_col).isNotNull())
            .groupBy(strat_col)
            .agg(F.count(F.lit(1)).alias(name))
        )

    # One row per category from here on.
    both, _ = settled(
        counted(original, "original_n").join(counted(sample, "sample_n"), strat_col, "full_outer"),
        "summary",
    )
    totals = {name: both.agg(F.sum(name)).scalar() for name in ("original_n", "sample_n")}
    return both.select(
        strat_col,
        "original_n",
        "sample_n",
        *[
            round_even(F.col(f"{side}_n") / totals[f"{side}_n"] * 100.0, 2).alias(f"{side}_pct")
            for side in ("original", "sample")
        ],
    ).orderBy(F.desc_nulls_last("original_n"), strat_col)
