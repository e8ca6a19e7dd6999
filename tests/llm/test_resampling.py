"""Importance resampling against a plain version: regular-expression words, zlib CRCs of joined strings, a sort in Python."""

import hashlib
import math
import zlib

import pytest

from complaintlens.llm import resampling

FOLDER = "/root/testdata/sf0.001"


def nulls_last(row):
    return tuple((v is None, v or 0) for v in row)


def plain(docs, targets, max_words=1, buckets=10_000, share=10, least=20, seed="2024"):
    def feats(text):
        w = resampling.words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = [0] * buckets, [0] * buckets
    per = []
    for i, text in docs:
        f, n = feats(text)
        per.append((i, f, n))
        for b in f:
            s[b] += 1
    for text in targets:
        for b in feats(text)[0]:
            t[b] += 1
    big_s, big_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + buckets)) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for row, (i, f, n) in enumerate(per):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, row])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=nulls_last)


def test_crc_of_joined_words():
    for a, b in [(b"", b"x"), (b"ab", b"cd"), ("ü".encode(), b" "), (b"x" * 300, b"y" * 77)]:
        assert resampling.crc_concat(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_automaton_finds_the_words():
    texts = [None, "", "  ", "Ab ab AB", "x1-y2_z ü.Ü a", "ab abc bc b c " * 3, "\x00a\x7fb"]
    for text, (n, total, kinds, counts) in zip(texts, resampling.feature_counts(texts, 3, 97)):
        w = resampling.words_of(text)
        want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert n == len(w) and total == len(want)
        assert sorted(b for b, c in zip(kinds, counts) for _ in range(c)) == want


@pytest.mark.parametrize("max_words", [1, 2])
def test_equal_to_plain_version(spark, max_words):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "one " * 30), (5, None), (7, ""), (7, ""), (-3, "Zz " * 25)], "doc_id long, text string")
    docs = docs.unionByName(extra).withColumn("rank", docs["doc_id"] * 0)  # a clashing column
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = resampling.importance_sample(docs, target, max_words=max_words).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows, [r.text for r in target.collect()], max_words)
    assert sorted((tuple(r) for r in got), key=nulls_last) == want
    assert sum(r.rank is not None for r in got) > 5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_sample(empty, empty).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in resampling.importance_sample(one, empty).collect()][0][:3] == (1, 2, plain([(1, "a b")], [])[0][2])
