"""Periodic runs against a brute-force search over every period and place."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np

from complaintlens.llm import periodic

sys.path.insert(0, str(Path(__file__).resolve().parent))
FOLDER = "/root/testdata/sf0.001"


def brute(s, least=6, times=4):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            if s[x] != s[x + q]:
                x += 1
                continue
            y = x
            while y < n - q and s[y] == s[y + q]:
                y += 1
            start, length = x, y - x + q
            smallest = next(p for p in range(1, q + 1) if all(s[z] == s[z + p] for z in range(start, start + length - p)))
            if smallest == q and length >= max(least, times * q):
                out.add((start, length, q))
            x = y
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(text, doc_id):
    words = periodic.planted([w for w in periodic.SPACES.split(text or "") if w], doc_id)
    found = brute(words)
    gone = {x for a, b, c in found for x in range(a + c, a + b)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    head = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    listing = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
    kept = " ".join(w for x, w in enumerate(words) if x not in gone).encode()
    return (doc_id, len(found), *head, hashlib.sha256(listing).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randrange(0, 60)
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        if rng.random() < 0.5 and n > 5:
            a, p = rng.randrange(n), rng.randrange(1, 6)
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
        assert periodic.runs(np.array(s, np.int64)) == brute(s)


def test_query_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, " ".join(r.text.split()[:150])) for r in docs.limit(60).collect()]
    planted = [i for i in range(400) if periodic.zlib.crc32(str(i).encode()) % 10 == 0][:8]
    rows = short + [(i, "a b c d e f g h i j k l m n o p q r s t u v w x") for i in planted]
    rows += [(None, "x y x y x y x y"), (3, None), (4, ""), (5, "  \t\n "), (6, "a a a a a a"), (6, "a a a a a a"), (7, "ab ab ab ab ab ab ab ab")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "'x' AS period")
    got = sorted((tuple(r) for r in periodic.periodic_runs(frame).collect()), key=repr)
    assert got == sorted((brute_row(t, i) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) >= 8


def test_long_text_is_whole():
    rng = random.Random(2)
    words = [f"w{rng.randrange(300)}" for _ in range(30000)]
    words[20000:] = (words[20000:20007] * 2000)[:10000]
    n_runs, start, length, period, *_ = periodic.describe(" ".join(words), None)
    assert (start, length, period) == (20000, 10000, 7) and n_runs >= 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0
