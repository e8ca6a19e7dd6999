"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merging of top lists.

Vectors are turned into whole numbers, ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``. They are
dealt into tiles of about ``tile_rows``, all rows into blocks of about ``block_rows``, both by a hash of a row mark, so a
repeated id or vector is spread like any other. Every pair of a tile and a block of the same width is one group of a cogroup:
a matrix product, and per query the best ``k`` of the block. Those lists are merged in a tree, ``fanout`` blocks at a time,
each level keeping the best ``k`` per query, until one list per query is left. No group grows with the table: a group holds
one tile and one block, a merge at most ``fanout * k`` rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.session import settled, written_once

# A component of magnitude LARGEST / scale or more leaves its vector out: all scores then fit 64 bits exactly.
LARGEST = 1 << 20
EXACT_IN_DOUBLE = float(1 << 53)
SUB_TILE = 512

PARTIAL = "qrid long, query_id long, block long, vec_id long, score long"


def _matrix(table: pa.Table) -> np.ndarray:
    width = int(table["width"][0].as_py()) if table.num_rows else 0
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(table.num_rows, width)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` of each row; columns are in the order that breaks ties; ``own`` is left out."""
    low = np.iinfo(np.int64).min + 1  # so that its negation exists
    scores = np.where(own, low, scores)
    if scores.shape[1] <= k:
        rows, cols = np.nonzero(~own)
        return rows, cols
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    above = scores > kth[:, None]
    equal = scores == kth[:, None]
    need = k - above.sum(axis=1)
    take = above | (equal & (np.cumsum(equal, axis=1) <= need[:, None]))
    take &= ~own
    return np.nonzero(take)


def partial_top(k: int):
    """Per query of a tile, the best ``k`` rows of a block: (qrid, query_id, block, vec_id, score)."""

    def compute(blocks: pa.Table, tiles: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("qrid", "query_id", "block", "vec_id", "score")})
        if not blocks.num_rows or not tiles.num_rows:
            return empty
        # Columns in the order of ties: smaller ids first, null ids last.
        ids = blocks["id"].combine_chunks()
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((filled, nulls))
        cand = _matrix(blocks)[order]
        crid = blocks["rid"].to_numpy()[order]
        cids = ids.take(pa.array(order))
        queries = _matrix(tiles)
        qrid, qid = tiles["rid"].to_numpy(), tiles["id"].to_numpy()
        big = float(np.abs(cand).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(cand.shape[1], 1)
        exact_double = big < EXACT_IN_DOUBLE
        out_r, out_c, out_s = [], [], []
        cand_t = cand.T.astype(np.float64) if exact_double else cand.T
        for at in range(0, len(queries), SUB_TILE):
            q = queries[at : at + SUB_TILE]
            scores = (q.astype(np.float64) @ cand_t).astype(np.int64) if exact_double else q @ cand_t
            own = qrid[at : at + SUB_TILE, None] == crid[None, :]
            rows, cols = _best(scores, own, k)
            out_r.append(rows + at)
            out_c.append(cols)
            out_s.append(scores[rows, cols])
        rows, cols, score = np.concatenate(out_r), np.concatenate(out_c), np.concatenate(out_s)
        return pa.table(
            {
                "qrid": pa.array(qrid[rows], pa.int64()),
                "query_id": pa.array(qid[rows], pa.int64()),
                "block": pa.array(np.full(len(rows), blocks["block"][0].as_py(), np.int64)),
                "vec_id": cids.take(pa.array(cols)),
                "score": pa.array(score, pa.int64()),
            }
        )

    return compute


def exact_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    every: int = 20,
    scale: float = 64.0,
    tile_rows: int = 2048,
    block_rows: int = 4096,
    fanout: int = 16,
) -> DataFrame:
    """For each query row, its ``k`` best other rows by inner product of ``floor(scale * x)``: query_id, rank, vec_id, score.

    Queries are the rows whose ``id_col`` is divisible by ``every``; candidates are all rows but the query's own row (a
    repeated row is a candidate of its copy). Rows whose vector is null, holds a null or non-finite component or one of
    magnitude 2^20 / scale or more take no part; a query meets only vectors of its own width. Ties go to the smaller
    id, null ids last. A query with fewer candidates gets all of them; repeated query rows get a list each. Other columns are
    left out; an empty table gives an empty result.
    """
    bound = LARGEST / scale
    ok = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < bound))
    whole = F.transform(vec_col, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    rows = written_once(
        vectors.where(F.col(vec_col).isNotNull() & ok)
        .select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(vec_col).alias("width"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "top-k-rows",
    )
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq"))
    sizes = sizes.where("nq > 0").select(
        "width", F.ceil(F.col("nq") / tile_rows).alias("tiles"), F.ceil(F.col("n") / block_rows).alias("blocks")
    )
    sizes, small = settled(sizes, "top-k-sizes", 10_000)
    sizes = F.broadcast(sizes) if small else sizes
    deal = F.xxhash64("rid")
    sized = rows.join(sizes, "width")
    # The queries are the same rows under new names, so the two sides of the cogroup are told apart.
    asked = rows.select(*(F.col(c).alias(c) for c in rows.columns)).join(sizes, "width")
    blocks = sized.select("width", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(deal, "blocks").alias("block"), "id", "v", "rid")
    tiles = asked.where(is_query).select(
        "width", F.pmod(deal, "tiles").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "rid"
    )
    keys = ["width", "tile", "block"]
    partial = blocks.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(partial_top(k), PARTIAL)
    level = written_once(partial, "top-k-partial")
    most = level.agg(F.max("block")).first()[0]
    spread = (most or 0) + 1
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    while spread > 1:
        level = level.withColumn("block", F.floor(F.col("block") / fanout))
        best = Window.partitionBy("qrid", "block").orderBy(*order)
        level = level.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        spread = -(-spread // fanout)
    final = Window.partitionBy("qrid").orderBy(*order)
    return level.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
