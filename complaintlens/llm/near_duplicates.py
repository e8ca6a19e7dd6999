"""Near-duplicates by SimHash, found with vantage-point trees.

Two fingerprints within ``radius`` bits differ by at most ``radius // blocks`` bits in one of ``blocks`` parts of the
fingerprint, so each part has a tree of its own over the values of that part. A node of a tree holds a vantage value and
a distance; values up to that distance go left, the others right. The upper levels of a tree are fitted on a bounded
sample and cut the values into shards. A fingerprint is stored in the one shard it belongs to and asks in every shard
that its ball overlaps by the triangle bound, so that every pair meets. Within a shard the tree is carried on in memory,
and what reaches a leaf together is compared on the whole fingerprint.

A shard returns a spanning forest of its links, not the links themselves, so groups of any size give no more rows than
they have members. Equal fingerprints are one row from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.llm.beside import map_beside
from complaintlens.llm.components import connected_components
from complaintlens.session import written_once

BITS, SEED = 64, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, width: int) -> int:
    """The fingerprint of a text: a bit is 1 if over half of the shingles of ``width`` words have it; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.diff(ends, prepend=0)
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)
    of = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    while part := [of(plain[a:b], SEED) for a, b in islice(spans, 1 << 16)]:
        hashes = np.array(part, "<u8").view(np.uint8).reshape(len(part), 8)
        counts += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, fp) per row of ``docs``; ``fp`` holds the 64 bits of the fingerprint as a signed long."""

    def mark(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        marks = np.array([simhash(text, width) for text in batch["text"]], np.uint64)
        yield pd.DataFrame({"fp": marks.view(np.int64)})

    return map_beside(docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")), ["id", *keep], mark, "fp long")


# A tree is None for a leaf, or (vantage, distance, left, right).
def _split(values: np.ndarray) -> tuple[int, int] | None:
    """A vantage value and a distance that parts ``values`` about in half; None if they are all the same."""
    vantage = values[len(values) // 2]
    distances = np.bitwise_count(values ^ vantage)
    if int(distances.max()) == 0:
        return None
    return int(vantage), min(int(np.median(distances)), int(distances.max()) - 1)


def grow(values: np.ndarray, levels: int):
    """The upper ``levels`` of a tree over a sample of values."""
    cut = _split(values) if levels and len(values) > 1 else None
    if cut is None:
        return None
    near = np.bitwise_count(values ^ np.uint64(cut[0])) <= cut[1]
    return *cut, grow(values[near], levels - 1), grow(values[~near], levels - 1)


def visit(tree, values: np.ndarray, rows: np.ndarray, radius: int, leaf: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, rows) of all leaves that the balls of ``radius`` round ``values`` overlap; radius 0 gives each its own."""
    if tree is None:
        yield leaf, rows
        return
    vantage, distance, left, right = tree
    apart = np.bitwise_count(values[rows] ^ np.uint64(vantage)).astype(np.int64)
    yield from visit(left, values, rows[apart <= distance + radius], radius, 2 * leaf)
    yield from visit(right, values, rows[apart > distance - radius], radius, 2 * leaf + 1)


class Links:
    """Sets of numbers joined by links, as a forest; the root of a set is its smallest number."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = np.stack([self.parent[a], self.parent[b]])
            while not np.array_equal(above := self.parent[roots], roots):
                roots = above
            low, high = roots.min(axis=0), roots.max(axis=0)
            open_ = low < high
            a, b = low[open_], high[open_]
            np.minimum.at(self.parent, b, a)
            while not np.array_equal(above := self.parent[self.parent], self.parent):
                self.parent = above


def shard_links(home: np.ndarray, asking: np.ndarray, part: Callable[[np.ndarray], np.ndarray], radius: int, near: int, leaf: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b), as fingerprints, of the pairs of ``home`` and ``asking`` within ``radius`` bits.

    Both are distinct fingerprints of one shard. The tree goes on below the shard: homes are parted by distance from a
    vantage value, and askers go to the sides that their ball of ``near`` bits overlaps, until few homes are left.
    """
    everything = np.union1d(home, asking)
    at_home, at_asking = np.searchsorted(everything, home), np.searchsorted(everything, asking)
    links = Links(len(everything))

    def search(h: np.ndarray, q: np.ndarray, home_part: np.ndarray, asking_part: np.ndarray, near: int) -> None:
        if not len(h) or not len(q):
            return
        cut = _split(home_part[h]) if len(h) > leaf else None
        if cut is None and len(h) > leaf and home_part is not home:
            # Many fingerprints agree in this part: go on with their other bits.
            return search(h, q, home, asking, radius)
        if cut is None:
            for block in np.array_split(q, -(-len(q) * len(h) // 2_000_000)):
                i, j = np.nonzero(np.bitwise_count(asking[block][:, None] ^ home[h][None, :]) <= radius)
                links.add(at_asking[block[i]], at_home[h[j]])
            return
        vantage, distance = np.uint64(cut[0]), cut[1]
        of_h, of_q = np.bitwise_count(home_part[h] ^ vantage), np.bitwise_count(asking_part[q] ^ vantage).astype(np.int64)
        search(h[of_h <= distance], q[of_q <= distance + near], home_part, asking_part, near)
        search(h[of_h > distance], q[of_q > distance - near], home_part, asking_part, near)

    search(np.arange(len(home)), np.arange(len(asking)), part(home), part(asking), near)
    child = np.flatnonzero(links.parent != np.arange(len(everything)))
    return everything[links.parent[child]], everything[child]


def near_duplicate_links(distinct: DataFrame, radius: int = 4, blocks: int = 4, shard_rows: int = 40_000, sample_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of ``distinct`` (fp, no repeats) which links of ``radius`` bits connect."""
    spark = distinct.sparkSession
    size, near = BITS // blocks, radius // blocks
    if BITS % blocks:
        raise ValueError("blocks must divide 64")
    total = distinct.count()
    # Vantage values come from a bounded sample. Only the balance of the shards depends on it, not the result.
    sample = np.array(distinct.orderBy(F.xxhash64("fp")).limit(sample_rows).toArrow()["fp"].to_pylist(), np.int64).view(np.uint64)
    levels = max(0, math.ceil(math.log2(max(1, total) / shard_rows)))

    def part_of(block: int) -> Callable[[np.ndarray], np.ndarray]:
        return lambda fp: (fp >> np.uint64(block * size)) & np.uint64(2**size - 1)

    trees = [grow(part_of(block)(sample), levels) for block in range(blocks)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            for block in range(blocks):
                values, rows = part_of(block)(fp.view(np.uint64)), np.arange(len(fp))
                for leaf, at in visit(trees[block], values, rows, 0):
                    yield pd.DataFrame({"block": block, "leaf": leaf, "asks": False, "fp": fp[at]})
                for leaf, at in visit(trees[block], values, rows, near):
                    yield pd.DataFrame({"block": block, "leaf": leaf, "asks": True, "fp": fp[at]})

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        fp, asks = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["asks"].to_numpy(bool)
        a, b = shard_links(fp[~asks], fp[asks], part_of(int(rows["block"].iloc[0])), radius, near) if len(rows) else (fp, fp)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInPandas(deal, "block int, leaf long, asks boolean, fp long")
    return dealt.groupBy("block", "leaf").applyInPandas(search, "a long, b long")


def _components(marked: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(fp, component) for each fingerprint of ``marked``."""
    distinct = written_once(marked.select("fp").distinct(), "distinct-fingerprints")
    parts = connected_components(near_duplicate_links(distinct, radius, blocks, shard_rows))
    return distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int = 4, shard_rows: int = 40_000
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (16 lowercase hex digits), component_id.

    Fingerprints of word shingles link at ``radius`` or fewer differing bits; the component is the smallest id that links
    reach, the row's own included. Null, empty and blank texts have fingerprint 0 and link like others. Repeated rows give
    repeated results. Null ids are never a component's id, unless a component has no other. Other columns are left out; an
    empty table gives an empty result.
    """
    marked = written_once(fingerprints(docs, id_col, text_col, width), "fingerprints")
    parts = written_once(_components(marked, radius, blocks, shard_rows), "fingerprint-components")
    low = marked.groupBy("fp").agg(F.min("id").alias("low")).join(parts, "fp").groupBy("component").agg(F.min("low").alias("component_id"))
    named = parts.join(low, "component").select(F.col("fp").alias("f"), "component_id")
    return marked.join(named, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int = 4, shard_rows: int = 40_000
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component of ``near_duplicates``.

    The row of the smallest id stays (a null id only if there is no other), of rows that repeat an id the one whose text has
    the smallest hash, of rows that repeat both any one.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    marked = written_once(fingerprints(texts, "id", "text", width, ("th",)), "fingerprints")
    parts = written_once(_components(marked, radius, blocks, shard_rows), "fingerprint-components")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")
    chosen = marked.groupBy("fp").agg(first).join(parts, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.th")
    return _rows_of(docs, chosen, id_col, text_col)


def _rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of ``docs`` for each id and text hash of ``chosen`` (id, th)."""
    # Two components can only choose the same id and text if they are one, so a text is chosen once.
    same = docs[id_col].eqNullSafe(chosen["id"]) & (F.xxhash64(docs[text_col]) == chosen["th"])
    marked_rows = docs.join(chosen, same, "left_semi").withColumn("__th", F.xxhash64(text_col))
    return marked_rows.dropDuplicates([id_col, "__th"]).drop("__th")
