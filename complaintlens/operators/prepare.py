"""From raw complaints to the cleaned table: mapping, filters, cleaning, previews.

Everything here is narrow: scan, project and filter in one stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintlens.functions import text as T

# The least number of words a cleaned narrative must have, and the width
# of a preview.
MIN_CLEAN_WORDS = 3
PREVIEW_WIDTH = 200


def with_product_category(
    df: DataFrame,
    product: str = "product",
    keywords: Mapping[str, Sequence[str]] = T.PRODUCT_KEYWORDS,
) -> DataFrame:
    return df.withColumn("product_category", T.map_product(F.col(product), keywords))


def filter_mapped(df: DataFrame, category: str = "product_category") -> DataFrame:
    return df.filter(F.col(category).isNotNull())


def filter_with_text(df: DataFrame, text: str = "narrative") -> DataFrame:
    return df.filter(T.has_text(F.col(text)))


def with_clean_narrative(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Adds ``clean_narrative`` and ``clean_word_count``.

    The cleaned text comes out of a one-element ``inline``. A filter on it then stays above,
    where pushing it into the scan would clean every text once for the filter and again for
    the output.
    """
    once = F.inline(F.array(F.struct(T.clean_lowered(F.col("_low")).alias("clean_narrative"))))
    cleaned = df.withColumn("_low", F.lower(text)).select("*", once).drop("_low")
    return cleaned.withColumn("clean_word_count", T.clean_word_count(F.col("clean_narrative")))


def filter_min_words(df: DataFrame, least: int = MIN_CLEAN_WORDS) -> DataFrame:
    return df.filter(F.col("clean_word_count") >= least)


def prepare_complaints(
    df: DataFrame,
    product: str = "product",
    text: str = "narrative",
    keywords: Mapping[str, Sequence[str]] = T.PRODUCT_KEYWORDS,
    least: int = MIN_CLEAN_WORDS,
) -> DataFrame:
    """Mapped, with text, cleaned, and with at least ``least`` words left.

    The cheap filters come first, so that the expressions of the cleaning run only on rows
    that pass them.
    """
    usable = filter_with_text(filter_mapped(with_product_category(df, product, keywords)), text)
    return filter_min_words(with_clean_narrative(usable, text), least)


def kept_flag(
    product: Column, text: Column, least: int = MIN_CLEAN_WORDS,
    keywords: Mapping[str, Sequence[str]] = T.PRODUCT_KEYWORDS,
) -> tuple[Column, Column, Column]:
    """Three cumulative conditions of ``prepare_complaints``: mapped, and with text, and long enough.

    None is ever null. The cleaning inside the third is evaluated only where the second holds.
    """
    mapped = T.map_product(product, keywords).isNotNull()
    with_text = mapped & T.has_text(text)
    words = T.clean_word_count(T.clean_narrative(text))
    long_enough = F.when(with_text, words >= least).otherwise(F.lit(False))
    return mapped, with_text, long_enough


def before_after_preview(
    df: DataFrame, key: str, text: str = "narrative", n: int = 2, width: int = PREVIEW_WIDTH
) -> DataFrame:
    """The first ``n`` usable rows by key, original and cleaned text side by side.

    Only those ``n`` texts are cleaned.
    """
    first = df.select(key, text).orderBy(key).limit(n)
    return with_clean_narrative(first, text).select(
        key,
        F.substring(text, 1, width).alias("before"),
        F.substring("clean_narrative", 1, width).alias("after"),
    )
