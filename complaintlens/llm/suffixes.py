"""Suffix arrays, common prefixes and anchored regions of byte strings, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 17  # windows looked at together
INDEX_BITS = np.uint64(19)  # holds a place within a block with its last window
_BYTE_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes at each place."""
    level, width, done = _BYTE_CODES[raw], 1, None
    rest, at = k, 0
    # k as a sum of powers of two, the smallest first
    while rest:
        if rest & 1:
            part = level[at : at + len(raw) - k + 1]
            done = part.copy() if done is None else done * _FACTORS[width % 64] + part
            at += width
        rest >>= 1
        if rest:
            level = level[:-width] * _FACTORS[(width + 1) % 64] + level[width:]
            width *= 2
    done ^= done >> np.uint64(31)
    return done * np.uint64(0x9E3779B97F4A7C15)


def _sliding_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` values in a row, from minima over powers of two, which may overlap."""
    level, width, n = values, 1, len(values) - length + 1
    while 2 * width <= length:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return np.minimum(level[:n], level[length - width : length - width + n])


def regions(texts: list[bytes], window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that share an anchor: (text number, first window, number of windows, anchor, several).

    The anchor of a window is the least hash of its ``k``-grams, so equal windows have equal anchors wherever they are.
    ``several`` tells that the k-gram was found at more than one place, without which the windows of a run all differ.
    Texts are laid end to end and handled in blocks; windows that lie in two texts are left out.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= window]
    at = 0
    while at < len(long):
        group, size = [], 0
        while at < len(long) and (not group or size + len(texts[long[at]]) <= BLOCK):
            group.append(long[at])
            size += len(texts[long[at]])
            at += 1
        raw = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        lengths = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(lengths)
        for start in range(0, size - window + 1, BLOCK):
            part = raw[start : start + BLOCK + window - 1]
            hashes = gram_hashes(part, k)
            marked = (hashes >> INDEX_BITS << INDEX_BITS) | np.arange(len(hashes), dtype=np.uint64)
            place = (_sliding_minimum(marked, window - k + 1) & ((np.uint64(1) << INDEX_BITS) - np.uint64(1))).astype(np.int64)
            anchor, windows = hashes[place], np.arange(start, start + len(place))
            text = np.searchsorted(ends, windows, side="right")
            inside = windows + window <= ends[text]
            new = np.ones(len(place), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            new[1:] |= inside[1:] != inside[:-1]
            first = np.flatnonzero(new)
            count = np.diff(first, append=len(place))
            keep = inside[first]
            last = place[first + count - 1]
            several = place[first] != last
            first, count, several = first[keep], count[keep], several[keep]
            number = text[first]
            yield np.array(group)[number], windows[first] - (ends - lengths)[number], count, anchor[first], several


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``raw`` ordered by their first ``depth`` bytes (a multiple of 8, at least 16), and the rank of each.

    Larsson and Sadakane's refinement: suffixes are sorted by their first 8 bytes; those that still agree with another are
    sorted by the rank of the suffix that starts where the known prefix ends, which doubles the prefix.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # The rank of a group is the place of its first suffix, plus one; beyond the end all ranks are 0.
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    known = 8
    while known < depth:
        step = min(known, depth - known)
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        suffix = order[open_]
        by = rank[suffix] * (n + 1) + rank[suffix + step]
        at = np.argsort(by)
        order[open_], by = suffix[at], by[at]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = by[1:] != by[:-1]
        new[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        known += step
    return order, rank[:n] - 1


def common_prefixes(raw: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix of each suffix and the one before it in ``order``, up to ``most`` bytes, by place in the text.

    Pieces of the text (``starts``, ``lengths``) are gone through side by side. A suffix shares all but one byte of what the
    suffix to its left shared. That does not hold where the limit was reached, as the order ends there: those begin anew.
    Suffixes of one ``rank`` agree up to the limit, which need not be compared.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(most + 8, np.uint8)])
    words = np.zeros(n + most, np.uint64)  # 8 bytes from each place, the first lowest
    for j in range(8):
        words |= padded[j : j + n + most].astype(np.uint64) << np.uint64(8 * j)
    previous = np.empty(n, np.int64)
    previous[order[1:]], previous[order[0]] = order[:-1], -1
    common = np.zeros(n, np.int64)
    order_of = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order_of], lengths[order_of]
    known = np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max(initial=0))):
        lanes = int(np.searchsorted(-lengths, -t, side="left"))
        i = starts[:lanes] + t
        j = previous[i]
        h = np.where((j < 0) | (rank[i] == rank[j]), most, known[:lanes])
        going = np.flatnonzero(h < most)
        while len(going):
            differ = words[i[going] + h[going]] ^ words[j[going] + h[going]]
            # Equal bytes at the low end: the lowest set bit tells how many.
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
            h[going] += same
            going = going[(same == 8) & (h[going] < most)]
        h = np.where(j < 0, 0, np.minimum(h, np.minimum(most, n - np.maximum(i, j))))
        common[i] = h
        known[:lanes] = np.where(h >= most, 0, np.maximum(h - 1, 0))
    return common


def compare_windows(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, window: int) -> np.ndarray:
    """-1, 0 or 1 as the window of ``a`` sorts before, equals or sorts after that of ``b``, for each pair of places."""
    out = np.zeros(len(at_a), np.int64)
    step = np.arange(window)
    for x in range(0, len(at_a), 20_000):
        left, right = a[at_a[x : x + 20_000, None] + step], b[at_b[x : x + 20_000, None] + step]
        first = (left != right).argmax(axis=1)
        rows = np.arange(len(first))
        out[x : x + 20_000] = np.sign(left[rows, first].astype(np.int64) - right[rows, first])
    return out


def find_windows(sorted_raw: np.ndarray, sorted_at: np.ndarray, raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: where each window of ``raw`` stands among the sorted windows, and whether it is one of them."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sorted_at), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less = compare_windows(sorted_raw, sorted_at[middle], raw, at[open_], window) < 0
        low[open_], high[open_] = np.where(less, middle + 1, low[open_]), np.where(less, high[open_], middle)
    found = np.zeros(len(at), bool)
    inside = np.flatnonzero(low < len(sorted_at))
    found[inside] = compare_windows(sorted_raw, sorted_at[low[inside]], raw, at[inside], window) == 0
    return low, found
