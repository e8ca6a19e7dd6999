"""Groups of texts with a Jaccard similarity of word shingles, found by SimHash and verified on the shingles.

Sets of shingles are similar only if the smaller one is not much smaller, so texts are dealt by classes of set size, and
a class only meets itself and the next one. Within these, fingerprints of 128 bits are compared. At similarity 0.8 two of
them differ by 19 bits on average with a deviation of 4; the radius is 5 deviations above that. What is found is a candidate: it
becomes a link once the shingles themselves have been compared.

Candidates are verified in two rounds, so that a large group of near copies does not give all its pairs. The first takes the nearest
candidate of each text; the second takes all candidates that are not in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.llm.beside import map_beside
from complaintlens.llm.components import connected_components
from complaintlens.llm.near_duplicates import LOWER, SEED, _rows_of
from complaintlens.session import written_once

# Bits that may differ, in the first half and in all 128. Majorities of few shingles turn more easily.
FEW, RADIUS, RADIUS_OF_FEW = 64, (24, 40), (28, 48)
AT_ONCE = 4_000_000


def shingles(text: str | None, width: int) -> set[bytes]:
    """Hashes (16 bytes) of the shingles of ``width`` words; of shorter texts the words, none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return set()
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.diff(ends, prepend=0)
    n, of = max(1, len(words) - width + 1), xxhash.xxh3_128_digest
    return {of(plain[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)}


def sketch(text: str | None, width: int) -> tuple[np.ndarray, int]:
    """Fingerprint (two longs) and number of the different shingles of a text."""
    found = shingles(text, width)
    if not found:
        return np.zeros(2, np.int64), 0
    hashes, counts = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16), np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(np.int64), len(found)


def size_bounds(largest: int, similarity: float) -> list[int]:
    """First set size of each class: sets of the similarity are in one class or in neighbouring ones. Class 0 is empty sets."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(int(bounds[-1] / similarity + 1e-9) + 1)
    return bounds


def near_pairs(home: pd.DataFrame, asking: pd.DataFrame, same: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asker, home, bits) of the candidates, by asker; pairs of one component are left out, of ``same`` rows each pair comes once."""
    a, b = (np.ascontiguousarray(rows[["lo", "hi"]].to_numpy(np.int64).T).view(np.uint64) for rows in (home, asking))
    th, other_th, n, other_n = home["th"].to_numpy(), asking["th"].to_numpy(), home["n"].to_numpy(), asking["n"].to_numpy()
    part, other_part = home["part"].to_numpy(), asking["part"].to_numpy()
    step = max(1, AT_ONCE // max(1, len(th)))
    for at in range(0, len(other_th), step):
        i, j = np.nonzero(np.bitwise_count(b[0, at : at + step, None] ^ a[0]) <= RADIUS_OF_FEW[0])
        i += at
        first = np.bitwise_count(b[0, i] ^ a[0, j])
        bits = first.astype(np.int64) + np.bitwise_count(b[1, i] ^ a[1, j])
        few = np.minimum(n[j], other_n[i]) < FEW
        good = (first <= np.where(few, RADIUS_OF_FEW[0], RADIUS[0])) & (bits <= np.where(few, RADIUS_OF_FEW[1], RADIUS[1])) & (part[j] != other_part[i])
        good &= np.minimum(n[j], other_n[i]) >= similarity * np.maximum(n[j], other_n[i]) - 1e-9
        if same:
            good &= th[j] < other_th[i]
        yield i[good], j[good], bits[good]


def _candidates(marked: DataFrame, similarity: float, shard_rows: int, nearest: bool) -> DataFrame:
    """(a, b) of ``marked`` (th, lo, hi, n, part): all candidates between different parts, or the nearest of each text and cell."""
    largest = marked.agg(F.max("n")).first()[0] or 0
    bounds = np.array(size_bounds(largest, similarity))
    of_class = F.lit(0)
    for k, low in enumerate(bounds.tolist(), 1):
        of_class = F.when(F.col("n") >= low, k).otherwise(of_class)
    counts = {r["c"]: r["count"] for r in marked.groupBy(of_class.alias("c")).count().collect()}
    shards = {c: -(-count // shard_rows) for c, count in counts.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kind = np.searchsorted(bounds, batch["n"].to_numpy(), side="right")
            for c in np.unique(kind).tolist():
                own = batch[kind == c]
                for s, rows in own.groupby(own["th"].to_numpy() % shards[c]):
                    for h, a in ((c, c), (c, c - 1)):  # at home, asked by its own class and the one below
                        for t in range(s if a == c else 0, shards.get(a, 0)):
                            yield rows.assign(h=h, hs=s, a=a, s=t, asks=False)
                    for h, a in ((c, c), (c + 1, c)):
                        for t in range(0, s + 1 if h == c else shards.get(h, 0)):
                            yield rows.assign(h=h, hs=t, a=a, s=s, asks=True)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        home, asking = group[~group["asks"]], group[group["asks"]]
        same = len(group) > 0 and (group["h"].iloc[0], group["hs"].iloc[0]) == (group["a"].iloc[0], group["s"].iloc[0])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j, bits in near_pairs(home, asking, same, similarity):
            if nearest:
                order = np.lexsort((bits, i))
                i, j = i[order], j[order]
                i, at = np.unique(i, return_index=True)
                j = j[at]
            found.append((asking["th"].to_numpy()[i], home["th"].to_numpy()[j]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    dealt = marked.mapInPandas(deal, "th long, lo long, hi long, n long, part long, h int, hs int, a int, s int, asks boolean")
    return dealt.groupBy("h", "hs", "a", "s").applyInPandas(search, "a long, b long")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of ``texts`` (th, text) whose shingles have the similarity; two sets without shingles are alike."""

    def hashes(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # 64 bits of a hash tell the shingles of two texts apart.
        yield pd.DataFrame({"grams": [np.unique(np.frombuffer(b"".join(shingles(t, width)), np.int64)[::2]) for t in batch["text"]]})

    involved = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
    wanted = texts.join(involved, F.col("th") == F.col("t"), "left_semi").dropDuplicates(["th"])
    sets = written_once(map_beside(wanted, ["th"], hashes, "grams array<long>"), "similar-shingles")
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("grams").alias("y")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b")


def similar_components(texts: DataFrame, width: int, similarity: float, shard_rows: int) -> DataFrame:
    """(th, component) for each different text of ``texts`` (th, text)."""

    def mark(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = [sketch(t, width) for t in batch["text"]]
        yield pd.DataFrame({"lo": [int(f[0]) for f, _ in found], "hi": [int(f[1]) for f, _ in found], "n": [n for _, n in found]})

    marked = written_once(map_beside(texts, ["th"], mark, "lo long, hi long, n long").dropDuplicates(["th"]), "similar-sketches")

    def with_parts(links: DataFrame) -> DataFrame:
        parts = connected_components(links)
        return written_once(marked.join(parts, F.col("th") == F.col("node"), "left").select(*marked.columns, F.coalesce("component", "th").alias("part")), "similar-parts")

    pairs = written_once(_candidates(marked.withColumn("part", F.col("th")), similarity, shard_rows, True), "similar-candidates")
    links = written_once(_verified(texts, pairs, width, similarity), "similar-links")
    parts = with_parts(links)
    pairs = written_once(_candidates(parts, similarity, shard_rows, False).join(pairs, ["a", "b"], "left_anti"), "similar-candidates")
    more = written_once(_verified(texts, pairs, width, similarity), "similar-links")
    if not more.isEmpty():
        parts = with_parts(links.unionByName(more))
    return parts.select("th", F.col("part").alias("component"))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, shard_rows: int = 40_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of similar texts.

    Texts link if the Jaccard similarity of their sets of shingles (``width`` words between ASCII white space, A-Z lower-cased) is
    ``similarity`` or more, 0.8 at least; links join groups. Null, empty and blank texts are one group. The row of the smallest id stays (a
    null id only if there is no other), of rows that repeat an id the one whose text has the smallest hash, of rows that repeat
    both any one.
    """
    if similarity < 0.8:
        raise ValueError("the radius is for a similarity of 0.8 or more")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    parts = similar_components(texts, width, similarity, shard_rows)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).groupBy("th").agg(first)
    chosen = rows.join(parts, "th").groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.th")
    return _rows_of(docs, chosen, id_col, text_col)
