"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

For a text of n words (as integers) the suffix array is built by prefix doubling, and the common prefix of neighbouring suffixes
from the rank tables of the doubling rounds. A bottom-up pass over the LCP values yields every LCP interval with the largest of
its child intervals; no tree is built. In an interval of depth D, each suffix i that is not in the largest child checks whether
suffix i + D (or i - D) lies in the same interval by its inverse rank: then the two share D words, a square of period D, and it is
branching if they share no more. Every square is a left rotation of a branching one, so rotating each branching square left as
far as the period holds gives the whole stretch of that period; stretches whose period is not the smallest (its root is a power)
are left out, the others are the runs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Words are parted by ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = re.compile(r"[\x20\x09-\x0D]+")

RESULT_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the periodic tail that the doc_id's CRC asks for (10 % of ids); a null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, inverse and the rank table of each doubling round (round m ranks prefixes of 2^m symbols)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64).reshape(-1)
    levels, k = [rank], 1
    while n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        first, after = rank[order], second[order]
        change = np.ones(n, bool)
        change[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change) - 1
        levels.append(rank)
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, rank, levels


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[r]: words shared by the suffixes at ranks r - 1 and r (lcp[0] = 0), from the rank tables, largest step first."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b, shared = sa[:-1], sa[1:], np.zeros(n - 1, np.int64)
    for m in range(len(levels) - 1, -1, -1):
        ia, ib = a + shared, b + shared
        inside = (ia < n) & (ib < n)
        table = levels[m]
        same = inside & (table[np.minimum(ia, n - 1)] == table[np.minimum(ib, n - 1)])
        shared += same * (1 << m)
    lcp[1:] = shared
    return lcp


def lcp_intervals(lcp: np.ndarray) -> np.ndarray:
    """Rows (depth, lb, rb, child_lb, child_rb) for every LCP interval of depth > 0; child: its largest child interval, or
    its first suffix if all children are single suffixes."""
    n = len(lcp)
    found = []
    stack = [[0, 0, 0, -1, -1]]  # depth, lb, size of largest child, its lb, its rb
    for i in range(1, n + 1):
        depth = int(lcp[i]) if i < n else -1
        lb, last = i - 1, None
        while stack and depth < stack[-1][0]:
            top = stack.pop()
            if top[3] < 0:
                top[3] = top[4] = top[1]
            found.append((top[0], top[1], i - 1, top[3], top[4]))
            lb, last = top[1], (top[1], i - 1)
            if stack and depth <= stack[-1][0]:
                _child(stack[-1], last)
                last = None
        if not stack:
            break
        if depth > stack[-1][0]:
            node = [depth, lb, 0, -1, -1]
            if last is not None:
                _child(node, last)
            stack.append(node)
    return np.array(found, np.int64).reshape(-1, 5)


def _child(node: list, child: tuple[int, int]) -> None:
    size = child[1] - child[0] + 1
    if size > node[2]:
        node[2], node[3], node[4] = size, child[0], child[1]


def branching_squares(s: np.ndarray) -> np.ndarray:
    """(start, period) of every branching square of ``s``: s[i:i+D] == s[i+D:i+2D] and s[i+D] != s[i+2D] (or the end)."""
    n = len(s)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    sa, isa, levels = suffix_array(s)
    intervals = lcp_intervals(common_prefixes(sa, levels))
    if not len(intervals):
        return np.zeros((0, 2), np.int64)
    depth, lb, rb, clb, crb = intervals.T
    # Suffixes of each interval outside its largest child: two ranges of ranks.
    first = np.concatenate([lb, crb + 1])
    last = np.concatenate([clb - 1, rb])
    d, low, high = np.tile(depth, 2), np.tile(lb, 2), np.tile(rb, 2)
    sizes = np.maximum(last - first + 1, 0)
    total = int(sizes.sum())
    offsets = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ranks = np.arange(total) - offsets + np.repeat(first, sizes)
    d, low, high = np.repeat(d, sizes), np.repeat(low, sizes), np.repeat(high, sizes)
    i = sa[ranks]
    padded = np.concatenate([s, [-1]])  # the end differs from every word

    def member(j):
        ok = (j >= 0) & (j < n)
        r = isa[np.clip(j, 0, n - 1)]
        return ok & (r >= low) & (r <= high)

    ahead = member(i + d)
    ahead &= padded[np.minimum(i + d, n)] != padded[np.minimum(i + 2 * d, n)]
    behind = member(i - d)
    behind &= padded[np.minimum(i, n)] != padded[np.minimum(i + d, n)]
    squares = np.concatenate([np.stack([i[ahead], d[ahead]], 1), np.stack([i[behind] - d[behind], d[behind]], 1)])
    return np.unique(squares, axis=0)


def _prime_factors(x: int) -> list[int]:
    found, f = [], 2
    while f * f <= x:
        if x % f == 0:
            found.append(f)
            while x % f == 0:
                x //= f
        f += 1
    return found + ([x] if x > 1 else [])


def runs(s: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``s`` with length >= max(least, times * period), by start then period."""
    found = set()
    for i, d in branching_squares(s).tolist():
        # Rotate left while the period holds: the first place where it fails, searched backwards in growing steps.
        start, step = i, 64
        while start > 0:
            lo = max(0, start - step)
            bad = np.nonzero(s[lo:start] != s[lo + d : start + d])[0]
            if len(bad):
                start = lo + int(bad[-1]) + 1
                break
            start, step = lo, step * 2
        length = i + 2 * d - start
        if length < max(least, times * d):
            continue
        # The period is the smallest unless the stretch also has period d / f for a prime f of d.
        if any(np.array_equal(s[start : start + length - d // f], s[start + d // f : start + length]) for f in _prime_factors(d)):
            continue
        found.add((start, length, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def describe(text: str | None, doc_id: int | None) -> tuple:
    """The result columns of one text (see ``periodic_runs``)."""
    words = planted([w for w in SPACES.split(text or "") if w], doc_id)
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1].astype(np.int64).reshape(-1) if words else np.zeros(0, np.int64)
    found = runs(ids)
    dropped = np.zeros(len(words), bool)
    for start, length, period in found:
        dropped[start + period : start + length] = True
    # Greatest length / period, compared exactly as fractions.
    best = min(found, key=lambda r: (_Ratio(r[1], r[2]), r[0], r[2]), default=None)
    listing = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for w, gone in zip(words, dropped) if not gone)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (len(found), *head, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


class _Ratio:
    """length / period, ordered from the greatest down, compared exactly."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def __lt__(self, other: _Ratio) -> bool:
        return self.a * other.b > other.a * self.b

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Ratio) and self.a * other.b == other.a * self.b


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are the runs of non-white-space of the whole text (null: none); ids whose CRC-32 ends in 0 in decimal get a
    periodic tail first (``planted``; null ids none). A run is a maximal stretch of smallest period q and length at least
    max(6, 4q). start, length, period describe the run of greatest length / period (ties: smaller start, then period), all
    null without runs. runs_sha256 hashes every run's ``start,length,period`` and a line feed, by start then period;
    collapsed_sha256 the words that no run holds after its first q words, joined by one space. Empty and null texts give 0
    runs and the hashes of empty strings; repeated rows give repeated results; other columns are left out.
    """
    fields = [f"{id_col} long", *RESULT.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [describe(t, i) for t, i in zip(batch.column(text_col).to_pylist(), batch.column(id_col).to_pylist())]
            columns = list(zip(*rows))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *RESULT_NAMES])

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias(text_col)).mapInArrow(scan, ", ".join(fields))
