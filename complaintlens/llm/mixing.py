"""Mixing sources to target weights with nested hash thresholds.

Every document has a fixed hash. Of each source the mix takes whole copies and, for the rest of its target, the
documents whose hash lies below a threshold. The threshold is found without sorting documents: sizes are summed by
source and hash bucket, the bucket in which the budget runs out is split into finer buckets, and so on until that
bucket holds one document. Only tables of one row per source and bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.llm.words import space_words
from complaintlens.session import written_once

HASH_BITS = 60
BUCKET_BITS = 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes. A target stops at ``cap``
    times the source's size and the excess goes to the others by weight. With sources in the order of size per weight the
    capped ones come first, and the share per unit of weight is the largest that any beginning of that order leaves.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(Window.partitionBy()).cast("double"), F.sum("weight").over(Window.partitionBy())
    unit = (total - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    ranked = ranked.withColumn("unit", unit)
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.max("unit").over(Window.partitionBy()))).select("source", "source_size", "target")


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash ``below`` which the sizes of ``sized`` (source, size, h) sum to at most its budget ``rest``.

    ``below`` is the hash of the first document, in the order of hashes, with which the sum exceeds the budget, or at
    most that of the documents before it; documents of equal hash are taken together or not at all.
    """
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"))
    shift = HASH_BITS
    while shift > 0:
        width = shift
        shift = max(0, shift - BUCKET_BITS)
        state = written_once(state, "mix-thresholds")
        if state.filter("open").isEmpty():
            break
        opened = state.filter("open").select(F.col("source").alias("s"), "below", "rest")
        inside = sized.join(opened, F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter((F.col("h") >= F.col("below")) & (F.col("h") < F.col("below") + F.lit(1 << width)))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("docs"), F.first("rest").alias("rest"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = buckets.withColumn("cum", running).filter(F.col("cum") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", "cum", "size", "docs")).alias("e"))
        edge = edge.select(F.col("source").alias("s"), (F.col("e.cum") - F.col("e.size")).alias("before"), F.shiftleft("e.bucket", shift).alias("at"), (F.col("e.docs") > 1).alias("more"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        found, still = F.col("at").isNotNull(), F.col("open")
        # No bucket exceeds the budget: it can only be that all documents fit.
        state = joined.select(
            "source",
            F.when(still & found, F.col("rest") - F.col("before")).otherwise(F.col("rest")).alias("rest"),
            F.when(still & found, F.col("at")).when(still, F.lit(1 << HASH_BITS)).otherwise(F.col("below")).alias("below"),
            (still & found & F.col("more") & F.lit(shift > 0)).alias("open"),
        )
    return written_once(state, "mix-thresholds").select("source", "below")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns ``keep``, source, size, source_size, target (of the source), taken (words the mix takes).

    Size is the number of words between white space. ``taken`` is a multiple of size, ``cap`` times at most. Null texts and
    blank texts have size 0 and take nothing; null sources are one source. A document's hash is that of its id and text, so
    rows without an id, or that share one, are told apart by their texts; only rows that repeat both share a hash and are
    taken alike. Other columns are left out; an empty table gives an empty result.
    """
    marked = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text_col), F.lit("")))
    digest = F.md5(marked.cast("binary"))
    carried = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(space_words(F.col(text_col))).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"), *[F.col(name).alias(c) for name, c in zip(keep, carried, strict=True)],
    )
    sized = written_once(rows.drop(*carried), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written_once(targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    below = hash_thresholds(sized, targets)
    plan = targets.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "copies", "below")
    # With columns to carry, the documents are read again rather than written with them.
    return (rows if keep else sized).join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), *[F.col(c).alias(name) for name, c in zip(keep, carried, strict=True)], F.col("source"), "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + (F.col("h") < F.col("below")).cast("long"))).alias("taken"),
    )
