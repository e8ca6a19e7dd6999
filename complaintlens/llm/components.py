"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.session import written_once


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each end of ``edges`` (a, b); the component is the smallest node that can be reached.

    Each round links the larger neighbours of a node to its smallest one, then the node and its smaller ones. The number of
    rows never exceeds the number of edges, and a hub's neighbours are not gathered anywhere: only minima per node are. Each
    round is written to the scratch folder, so a lost executor costs that round at most.
    """
    current = written_once(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every node now has smaller neighbours only on its own rows.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = written_once(small.filter("a <> b").distinct(), "components")
        if following.count() == current.count() and following.exceptAll(current).isEmpty():
            return following.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        current = following
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
