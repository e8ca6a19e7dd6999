"""Aggregates of the dashboard over the chunk (or complaint) metadata.

All group in the scan first, so a value that holds a third of all rows crosses the shuffle
as one counted row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.functions import text as T


def product_volume(
    df: DataFrame, category: str = "product_category", products: Sequence[str] = T.PRODUCTS
) -> DataFrame:
    """Rows per category in the order of ``products``; those without rows are left out."""
    return (
        df.filter(F.col(category).isin(*products))
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", F.array_position(F.lit(list(products)), F.col(category)))
        .orderBy("position")
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values, ties by value, with their rank."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )
    # At most n rows are left, so one frame over all of them is small.
    return counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), column))
    )


def top_companies(df: DataFrame, column: str = "company", n: int = 10) -> DataFrame:
    return top_values(df, column, n)


def state_distribution(df: DataFrame, column: str = "state", n: int = 15) -> DataFrame:
    """Blank states count as a value, null ones do not."""
    return top_values(df, column, n)


def top_issues(
    df: DataFrame,
    category: str = "product_category",
    issue: str = "issue",
    n: int = 5,
    products: Sequence[str] = T.PRODUCTS,
) -> DataFrame:
    """The ``n`` most frequent issues of each category, stripped, blank ones left out."""
    counts = (
        df.filter(F.col(category).isin(*products))
        .select(category, T.strip(F.col(issue)).alias("issue"))
        .filter(F.col("issue") != "")
        .groupBy(category, "issue")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(category).orderBy(F.desc("n"), "issue")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .withColumn("label", T.issue_label(F.col("issue")))
    )


def kpis(
    df: DataFrame,
    category: str = "product_category",
    company: str = "company",
    state: str = "state",
) -> DataFrame:
    """Rows and numbers of distinct categories, companies and states, as shown on the cards.

    A column that the table lacks has its fixed placeholder: "4" for the categories, a dash
    for the others. Counting per combination first makes one aggregation in the scan serve
    all distinct counts.
    """
    wanted = {"n_products": (category, "4"), "n_companies": (company, "—"), "n_states": (state, "—")}
    present = [column for column, _ in wanted.values() if column in df.columns]
    combinations = df.groupBy(*present).agg(F.count(F.lit(1)).alias("n"))
    figures = [
        F.count_distinct(column).alias(name) if column in present else F.lit(missing).alias(name)
        for name, (column, missing) in wanted.items()
    ]
    return combinations.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), *figures)
