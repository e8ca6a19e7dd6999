"""Profile of a raw complaint table.

Text length statistics all start from ``word_frequencies``: one row per distinct word
count with the number of narratives. That table is made by a partial aggregation in the
scan and has as many rows as there are distinct lengths, so what follows on it (exact
percentiles, fences, histogram bins) is small whatever the number of complaints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from complaintlens.functions import text as T
from complaintlens.operators.prepare import MIN_CLEAN_WORDS, kept_flag

# A narrative under this many words is short, one over this percentile long.
SHORT_WORDS = 5
LONG_PERCENTILE = 0.99
HISTOGRAM_BINS = 80
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _whole() -> WindowSpec:
    """The frequency table as one frame. Its rows are bounded by the longest text."""
    return Window.partitionBy(F.lit(0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with each value's share of the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # The total is a query of its own, so the many values there may be are not windowed in one task.
    total = df.agg(F.count(column)).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), column)


def mapped_counts(df: DataFrame, category: str = "product_category") -> DataFrame:
    """Rows per mapped category; the unmapped ones under a null category, 0 included."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    none = df.sparkSession.createDataFrame([(None, 0)], counts.schema)
    return counts.unionAll(none).groupBy(category).agg(F.sum("n").alias("n"))


def _per_column(df: DataFrame, measure, name: str) -> DataFrame:
    """One row per column of ``df`` with ``measure(column)``, from one pass over ``df``."""
    row = df.agg(*[measure(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(name)) for c in df.columns]
    )
    return row.select(F.inline(pairs))


def pct_missing(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, two decimals, only columns that have some."""
    missing = _per_column(df, lambda c: F.avg(c.isNull().cast("int")), "share")
    return (
        missing.filter(F.col("share") > 0)
        .select("column_name", T.round_even(F.col("share") * 100.0, 2).alias("pct_missing"))
        .orderBy(F.desc("pct_missing"), "column_name")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type and number of non-null values of each column."""
    counts = _per_column(df, F.count, "non_null")
    types = {field.name: field.dataType.simpleString() for field in df.schema}
    entries = [F.lit(part) for pair in types.items() for part in pair]
    return counts.withColumn("dtype", F.create_map(*entries)[F.col("column_name")])


def word_frequencies(df: DataFrame, text: str) -> DataFrame:
    """Distinct word counts ``w`` of the texts that are not blank, with their number ``n``."""
    return (
        df.filter(T.has_text(F.col(text)))
        .select(T.word_count(F.col(text)).cast("long").alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _percentile(share: float) -> Column:
    return F.percentile("w", F.lit(share), F.col("n"))


def word_count_stats(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Count, mean, sample standard deviation, extremes and percentiles of the word count."""
    w, n = F.col("w").cast("double"), F.col("n").cast("double")
    sums = word_frequencies(df, text).agg(
        F.sum("n").alias("n_texts"),
        F.sum(w * n).alias("s1"),
        F.sum(w * w * n).alias("s2"),
        F.min("w").alias("min_words"),
        F.max("w").alias("max_words"),
        *[_percentile(share).alias(name) for name, share in PERCENTILES.items()],
    )
    count = F.col("n_texts")
    variance = F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), count), count - 1)
    return sums.select(
        F.coalesce(count, F.lit(0)).alias("n_texts"),
        F.try_divide(F.col("s1"), count).alias("mean_words"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_words"),
        "min_words",
        "max_words",
        *PERCENTILES,
    )


def tail_counts(df: DataFrame, text: str = "narrative", short: int = SHORT_WORDS) -> DataFrame:
    """Number of short and of long narratives, and the length over which one is long."""
    marked = word_frequencies(df, text).withColumn("p99", _percentile(LONG_PERCENTILE).over(_whole()))
    return marked.agg(
        F.coalesce(F.sum(F.when(F.col("w") < short, F.col("n"))), F.lit(0)).alias("n_short"),
        F.coalesce(F.sum(F.when(F.col("w") > F.col("p99"), F.col("n"))), F.lit(0)).alias("n_long"),
        F.max("p99").alias("long_threshold"),
    )


def short_narratives(
    df: DataFrame, key: str, text: str = "narrative", short: int = SHORT_WORDS, n: int = 5
) -> DataFrame:
    """The first ``n`` narratives, by key, of under ``short`` words."""
    return (
        df.filter(T.has_text(F.col(text)))
        .select(key, F.col(text).alias("narrative"), T.word_count(F.col(text)).alias("word_count"))
        .filter(F.col("word_count") < short)
        .orderBy(key)
        .limit(n)
    )


def long_narratives(df: DataFrame, key: str, text: str = "narrative") -> DataFrame:
    """All narratives with more words than the 99th percentile."""
    threshold = word_frequencies(df, text).agg(_percentile(LONG_PERCENTILE)).scalar()
    return (
        df.filter(T.has_text(F.col(text)))
        .select(key, T.word_count(F.col(text)).alias("word_count"))
        .filter(F.col("word_count") > threshold)
    )


def narrative_coverage(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Rows with and without a narrative, and their shares."""
    counted = df.agg(
        F.count_if(T.has_text(F.col(text))).alias("n_with"), F.count(F.lit(1)).alias("n_total")
    )
    without = F.col("n_total") - F.col("n_with")
    return counted.select(
        "n_with",
        without.alias("n_without"),
        "n_total",
        F.try_divide(F.col("n_with"), F.col("n_total")).alias("share_with"),
        F.try_divide(without, F.col("n_total")).alias("share_without"),
    )


def filter_funnel(
    df: DataFrame, product: str = "product", text: str = "narrative", least: int = MIN_CLEAN_WORDS
) -> DataFrame:
    """Rows left after each step of the preparation, from one pass."""
    mapped, with_text, long_enough = kept_flag(F.col(product), F.col(text), least)
    flags = df.select(mapped.alias("mapped"), with_text.alias("with_text"), long_enough.alias("kept"))
    counted = flags.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("mapped").alias("after_product"),
        F.count_if("with_text").alias("after_text"),
        F.count_if("kept").alias("n_final"),
    )
    removed = F.col("n_rows") - F.col("after_text")
    return counted.select(
        "n_rows",
        "after_product",
        "after_text",
        removed.alias("n_removed"),
        F.try_divide(removed, F.col("n_rows")).alias("share_removed"),
        (F.col("after_text") - F.col("n_final")).alias("near_empty"),
        "n_final",
    )


def word_histogram(df: DataFrame, text: str = "narrative", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Number of narratives per bin of equal width between the shortest and the longest.

    The last bin includes its upper end. ``in_view`` says whether the bin starts at or below
    the 99th percentile, where the plot is cut.
    """
    marked = word_frequencies(df, text).select(
        "w",
        "n",
        F.min("w").over(_whole()).alias("lo"),
        F.max("w").over(_whole()).alias("hi"),
        _percentile(LONG_PERCENTILE).over(_whole()).alias("p99"),
    )
    position = F.try_divide((F.col("w") - F.col("lo")) * float(bins), F.col("hi") - F.col("lo"))
    number = F.least(F.floor(F.coalesce(position, F.lit(0.0))) + 1, F.lit(bins)).cast("int")
    start = F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / float(bins)
    return (
        marked.withColumn("bin", number)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
             F.first("p99").alias("p99"))
        .select("bin", "n", start.alias("bin_start"), (start <= F.col("p99")).alias("in_view"))
    )


def box_stats(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges) and number of outliers."""
    marked = word_frequencies(df, text).select(
        "w",
        "n",
        *[_percentile(share).over(_whole()).alias(name)
          for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        _percentile(LONG_PERCENTILE).over(_whole()).alias("view_limit"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("w").between(F.col("q1") - reach, F.col("q3") + reach)
    return marked.agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("w"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("w"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        F.max("view_limit").alias("view_limit"),
    )


def eda_summary(
    df: DataFrame, product: str = "product", text: str = "narrative", short: int = SHORT_WORDS
) -> DataFrame:
    """The figures of the closing summary, from one pass over the table.

    The pass counts rows per product, word count and kept or not; all figures come from
    those groups.
    """
    _, _, kept = kept_flag(F.col(product), F.col(text))
    words = F.when(T.has_text(F.col(text)), T.word_count(F.col(text)))
    groups = (
        df.select(F.col(product).alias("product"), words.cast("long").alias("w"), kept.alias("kept"))
        .groupBy("product", "w", "kept")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("product_n", F.sum("n").over(Window.partitionBy("product")))
    )
    named = F.col("product").isNotNull()
    figures = groups.agg(
        F.sum("n").alias("total"),
        F.count_distinct("product").alias("n_products"),
        F.min(F.when(named, F.struct((-F.col("product_n")).alias("least"), "product"))).alias("top"),
        F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n"))), F.lit(0)).alias("n_with"),
        _percentile(0.5).alias("median_words"),
        _percentile(LONG_PERCENTILE).alias("p99_words"),
        F.coalesce(F.sum(F.when(F.col("w") < short, F.col("n"))), F.lit(0)).alias("n_short"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("n_kept"),
    )
    total = F.col("total")
    return figures.select(
        "total",
        "n_products",
        F.col("top.product").alias("top_product"),
        (-F.col("top.least")).alias("top_product_n"),
        F.try_divide(-F.col("top.least"), total).alias("top_product_share"),
        "n_with",
        (total - F.col("n_with")).alias("n_without"),
        F.try_divide(F.col("n_with"), total).alias("share_with"),
        "median_words",
        "p99_words",
        "n_short",
        "n_kept",
        F.try_divide(F.col("n_kept"), total).alias("share_kept"),
    )
