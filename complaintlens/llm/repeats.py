"""Removal of passages that occur elsewhere, by suffix arrays over shards.

Two equal windows of ``window`` bytes have the same anchor, the least hash of the k-grams in them. So only windows whose
anchor was found twice can be repeated, and all windows with one anchor are dealt to one task:

1. Texts are cut into regions, runs of windows with one anchor. Anchors are counted; regions with a lone one are dropped.
2. The pieces of text under the other regions are cut out, equal pieces become one row with a count, and the pieces go to
   shards in the order of their anchors.
3. A suffix array with common prefixes is made of each shard; windows that share all their bytes with a neighbour are
   repeated. If an anchor goes on in the next shard, the sorted windows of its shards are merged by binary search.
4. What was found goes back to the texts, which are cut.

Texts with equal bytes count as one text with a number of copies. An anchor with very many different pieces (a common
line in changing surroundings) would make one task large: its pieces are taken as texts themselves and cut anew with a
longer anchor, at last one as long as the window, of which equal ones are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.llm import suffixes
from complaintlens.llm.beside import map_beside
from complaintlens.session import written_once

KEY = ["k1", "k2"]
BYTES_AT_ONCE = 1 << 20


def _key_columns(data):
    """Two longs that stand for a binary: its MD5."""
    digest = F.md5(data)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 17))]


def _text_groups(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, a bounded number of bytes at a time (or one text)."""
    sizes = batch["data"].map(len).cumsum() // BYTES_AT_ONCE
    for _, part in batch.groupby(sizes.to_numpy(), sort=False):
        yield part


def find_regions(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(k1, anchor, place) of the regions of ``texts`` (k1, data); ``place`` packs first window, number of windows and several.

    Half of a text's key is enough here: should two texts share it, each has pieces cut at the other's places as well, and
    pieces are compared by their bytes.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _text_groups(batch):
                k1 = part["k1"].to_numpy()
                for number, start, count, anchor, several in suffixes.regions(part["data"].tolist(), window, k):
                    yield pd.DataFrame({"k1": k1[number], "anchor": anchor.view(np.int64), "place": (start << 20) | (count << 1) | several})

    return texts.select("k1", "data").mapInPandas(cut, "k1 long, anchor long, place long")


def cut_pieces(texts: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """A row per text of ``texts`` (k1, k2, data; no repeats) and place of ``places`` (k1, anchor, place).

    Columns k1, k2, anchor, start, n (windows), several, the piece and its key (m1, m2).
    """
    gathered = places.groupBy("k1").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _text_groups(batch):
                rows = []
                for k1, k2, data, anchors, found in part.itertuples(index=False):
                    for anchor, place in zip(anchors.tolist(), found.tolist(), strict=True):
                        start = place >> 20
                        n = min((place >> 1) & 0x7FFFF, len(data) - window + 1 - start)
                        if n > 0:
                            piece = data[start : start + n + window - 1]
                            digest = hashlib.md5(piece).digest()
                            m1, m2 = int.from_bytes(digest[:8], "big") >> 1, int.from_bytes(digest[8:], "big") >> 1
                            rows.append((k1, k2, anchor, start, n, bool(place & 1), m1, m2, piece))
                yield pd.DataFrame(rows, columns=["k1", "k2", "anchor", "start", "n", "several", "m1", "m2", "piece"])

    return texts.join(gathered, "k1").select(*KEY, "data", "anchors", "places").mapInPandas(
        cut, "k1 long, k2 long, anchor long, start long, n long, several boolean, m1 long, m2 long, piece binary"
    )


class _Spanning:
    """The sorted windows so far of an anchor that goes on in the next shard."""

    def __init__(self, anchor: int) -> None:
        self.anchor, self.raw, self.at, self.owner = anchor, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

    def merge(self, raw: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Take in distinct sorted windows; which of them were there already, and the owners of those."""
        place, found = suffixes.find_windows(self.raw, self.at, raw, at, window)
        owners = self.owner[place[found]]
        used = np.zeros(len(raw) + 1, np.int64)  # keep only the text under the new windows
        np.add.at(used, at[~found], 1)
        np.add.at(used, at[~found] + window, -1)
        kept = np.cumsum(used)[:-1] > 0
        moved = np.cumsum(kept) - 1 + len(self.raw)
        self.at = np.insert(self.at, place[~found], moved[at[~found]])
        self.owner = np.insert(self.owner, place[~found], owner[~found], axis=0)
        self.raw = np.concatenate([self.raw, raw[kept]])
        return found, owners


def repeated_in_shard(pieces: pd.DataFrame, window: int, spanning: _Spanning | None, goes_on: bool) -> tuple[list[tuple], _Spanning | None]:
    """Runs (m1, m2, first, n) of repeated windows in a shard of different ``pieces``, in the order of their anchors.

    ``spanning`` holds the earlier windows of the first anchor, if it began in an earlier shard; ``goes_on`` tells that the
    last anchor continues in the next one.
    """
    anchor, n, copies = pieces["anchor"].to_numpy(), pieces["n"].to_numpy(), pieces["copies"].to_numpy()
    m = pieces[["m1", "m2"]].to_numpy()
    out = [(*m[i], 0, n[i]) for i in np.flatnonzero(copies > 1)]
    following = None
    alone = ~pieces["several"].to_numpy(bool) & ~pieces.duplicated("anchor", keep=False).to_numpy()
    last = anchor[-1]
    open_anchors = {spanning.anchor} if spanning else set()
    if goes_on:
        open_anchors.add(last)
    for a in open_anchors:
        alone &= anchor != a
    kept = np.flatnonzero(~alone)
    if len(kept):
        parts = pieces["piece"].to_numpy()[kept]
        raw, lengths = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths) - lengths
        order, rank = suffixes.suffix_array(raw, window)
        common = suffixes.common_prefixes(raw, order, rank, starts, lengths, window)
        piece = np.repeat(np.arange(len(kept)), lengths)
        real = np.arange(len(raw)) - starts[piece] < n[kept][piece]  # starts of windows that lie in their piece
        run = np.cumsum(common[order] < window)
        run_of = np.empty(len(raw), np.int64)
        run_of[order] = run
        members = np.bincount(run, real[order], minlength=int(run[-1]) + 1)
        hit = real & (members[run_of] > 1)
        for a in open_anchors:
            current = spanning if spanning and spanning.anchor == a else _Spanning(a)
            mine = order[real[order] & (anchor[kept][piece[order]] == a)]
            mine = mine[np.r_[True, run_of[mine][1:] != run_of[mine][:-1]]] if len(mine) else mine
            owner = np.concatenate([m[kept[piece[mine]]], (mine - starts[piece[mine]])[:, None]], axis=1)
            found, owners = current.merge(raw, mine, owner, window)
            again = np.isin(run_of, run_of[mine[found]]) & real
            hit |= again
            out += [(int(o[0]), int(o[1]), int(o[2]), 1) for o in owners]
            if goes_on and a == last:
                following = current
        edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        out += [(*m[kept[piece[x]]], x - starts[piece[x]], y - x) for x, y in zip(first, stop, strict=True)]
    return out, following


def repeated_in_pieces(distinct: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(m1, m2, first, n): runs of repeated windows of different pieces (anchor, m1, m2, piece, n, several, copies)."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
        waiting: pd.DataFrame | None = None
        for batch in batches:
            waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            sizes = waiting["piece"].map(len).cumsum().to_numpy()
            done = 0
            while len(sizes) and sizes[-1] - (sizes[done - 1] if done else 0) > shard_bytes:
                stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + shard_bytes, side="right")))
                if stop >= len(sizes):
                    break
                yield waiting.iloc[done:stop], bool(waiting["anchor"].iloc[stop] == waiting["anchor"].iloc[stop - 1])
                done = stop
            waiting = waiting.iloc[done:].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield waiting, False

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spanning = None
        for pieces, goes_on in shards(batches):
            rows, spanning = repeated_in_shard(pieces, window, spanning, goes_on)
            yield pd.DataFrame(rows, columns=["m1", "m2", "first", "n"], dtype=np.int64)

    ordered = distinct.select("anchor", "m1", "m2", "piece", "n", "several", "copies").repartition("anchor").sortWithinPartitions("anchor", "m1", "m2")
    return ordered.mapInPandas(search, "m1 long, m2 long, first long, n long")


def _repeated_anchors(places: DataFrame) -> DataFrame:
    counts = places.groupBy("anchor").agg(F.count("*").alias("c"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("s"))
    return counts.filter((F.col("c") > 1) | (F.col("s") > 0)).select("anchor")


def repeated_windows(texts: DataFrame, unique: DataFrame, window: int, ks: tuple[int, ...], shard_bytes: int, max_pieces: int) -> DataFrame:
    """(k1, k2, start, n): runs of windows that occur in another place or another text.

    ``texts`` and ``unique`` have k1, k2 and data; ``unique`` has each text once. That a text has copies is left to the caller.
    """
    found = find_regions(texts.filter(F.octet_length("data") >= window), window, ks[0])
    places = written_once(found.join(_repeated_anchors(found), "anchor").distinct(), "repeat-places")
    # Copies of a text have been counted above; now each text counts once.
    places = places.join(_repeated_anchors(places), "anchor").select("k1", "anchor", "place")
    pieces = written_once(cut_pieces(unique, places, window), "repeat-pieces")
    distinct = pieces.groupBy("anchor", "m1", "m2").agg(
        F.first("piece").alias("piece"), F.first("n").alias("n"), F.max("several").alias("several"), F.count("*").alias("copies")
    )
    runs = None
    if len(ks) > 1:
        sizes = pieces.select("anchor", "m1", "m2").distinct().groupBy("anchor").count()
        large = written_once(sizes.filter(F.col("count") > max_pieces).select("anchor"), "repeat-large")
        if not large.isEmpty():
            within = written_once(distinct.join(large, "anchor").select(F.col("m1").alias("k1"), F.col("m2").alias("k2"), F.col("piece").alias("data"), "n", "copies"), "repeat-again")
            runs = repeated_windows(within, within, window, ks[1:], shard_bytes, max_pieces)
            runs = runs.unionByName(within.filter("copies > 1").select(*KEY, F.lit(0).cast("long").alias("start"), "n"))
            runs = runs.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("start").alias("first"), "n")
            distinct = distinct.join(large, "anchor", "left_anti")
    here = repeated_in_pieces(distinct, window, shard_bytes)
    runs = here if runs is None else here.unionByName(runs)
    return pieces.select(*KEY, "start", "m1", "m2").join(runs, ["m1", "m2"]).select(*KEY, (F.col("start") + F.col("first")).alias("start"), "n")


def cover(starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under runs of windows."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + counts + window - 1)[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[new[1:], True]]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = 200, ks: tuple[int, ...] = (48, 128, 200), shard_bytes: int = 1 << 20,
    max_pieces: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns ``keep``, n_bytes, n_removed, spans and kept (the bytes that stay).

    Texts are UTF-8 bytes, null texts empty. Each byte goes that is covered by a string of ``window`` bytes which also starts
    elsewhere, in the same or another text, as judged on the input; ``spans`` lists the removed runs (start, end), none
    touching another. Texts shorter than ``window`` stay whole. All copies of a repeated text or row go, none is left as the
    original. Null ids stay null, other columns are left out, an empty table gives an empty result.
    """
    if any(k > window for k in ks) or window > 2000:
        raise ValueError("anchors are no longer than the window, and that has 2000 bytes at most")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(data.alias("data")).select(*_key_columns(F.col("data")), "data")
    unique = keyed.groupBy(*KEY).agg(F.first("data").alias("data"))
    inside = repeated_windows(keyed, unique, window, ks, shard_bytes, max_pieces)
    copies = keyed.filter(F.octet_length("data") >= window).groupBy(*KEY).agg(F.count("*").alias("c"), F.max(F.octet_length("data")).alias("size"))
    whole = copies.filter("c > 1").select(*KEY, F.lit(0).cast("long").alias("start"), (F.col("size") - window + 1).cast("long").alias("n"))
    spans = inside.unionByName(whole).groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))

    def cut(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part in _text_groups(batch):
            rows = []
            for data, starts, counts in part[["data", "starts", "counts"]].itertuples(index=False):
                if starts is None:
                    rows.append((len(data), 0, [], data))
                    continue
                first, end = cover(np.asarray(starts), np.asarray(counts), window)
                kept = [data[a:b] for a, b in zip(np.r_[0, end], np.r_[first, len(data)], strict=True)]
                rows.append((len(data), int((end - first).sum()), [{"start": a, "end": b} for a, b in zip(first.tolist(), end.tolist(), strict=True)], b"".join(kept)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])

    names = [id_col, *keep]
    carried = [f"c{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(name).alias(c) for name, c in zip(names, carried, strict=True)], data.alias("data")).withColumns(dict(zip(KEY, _key_columns(F.col("data")), strict=True)))
    made = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    found = map_beside(rows.join(spans, KEY, "left").drop(*KEY), carried, cut, made)
    return found.withColumnsRenamed(dict(zip(carried, names, strict=True)))
