"""Ids above 2^53 beside nulls, rows that share an id, and near copies by Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from complaintlens.llm import near_duplicates, quality, quality_rules, repeats, similar, toxicity

IDS = [9007199254740993, 1152921504606846977, None, 5]
KEPT = {
    "repeats": lambda docs, labels: repeats.remove_repeats(docs, keep=("big",)),
    "toxicity": toxicity.score_toxicity,
    "quality": quality.score_quality,
    "keep_quality": lambda docs, labels: quality.keep_quality(docs, labels, threshold=0.0),
    "near": lambda docs, labels: near_duplicates.near_duplicates(docs),
    "keep_one": lambda docs, labels: near_duplicates.keep_one_of_each(docs),
    "rules": lambda docs, labels: quality_rules.apply_quality_rules(docs),
}


@pytest.mark.parametrize("name", KEPT)
def test_large_ids_beside_a_null(spark, name):
    rows = [(i, i, f"text{n} of its own, number{n} and so{n} on{n}") for n, i in enumerate(IDS)]
    docs = spark.createDataFrame(rows, "doc_id long, big long, text string").coalesce(1)
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    found = KEPT[name](docs, labels)
    assert {r.doc_id for r in found.collect()} == set(IDS)
    if "big" in found.columns:
        assert {r.big for r in found.collect()} == set(IDS)


def test_clean_rows_with_the_id_of_a_contaminated_one_stay(spark, tmp_path):
    leak = "the quick brown fox jumps over the lazy dog today"
    rows = [(None, f"see {leak} or not"), (None, "clean without an id"), (None, None), (3, leak), (3, "clean with a shared id"), (3, leak), (4, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted(((i, t) for i, t in rows if leak not in (t or "")), key=str)


@pytest.mark.parametrize("shard_rows", [40_000, 50])
def test_near_copies_equal_brute_force(spark, shard_rows):
    """Copies with some words changed, about the threshold: groups by exact Jaccard of five words."""
    rng = random.Random(3)
    texts = [None, "", "  ", "a b", "A  b", "a c"]
    for size in [6, 9, 12, 30, 60] * 4 + [150, 400] * 15:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1 + max(1, size // 40))):
                copy[rng.randrange(size)] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy[rng.randrange(1 + size // 20) :]))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda x, y: x == y or 10 * len(x & y) >= 8 * len(x | y)
    part = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if alike(sets[i], sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.88 * len(sets[i] | sets[j]) for i, j in pairs) > 20
    for i, j in pairs:
        a, b = part[i], part[j]
        part = [min(a, b) if p in (a, b) else p for p in part]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i for i, p in enumerate(part) if i == p}
    found = similar.keep_one_of_similar(docs, shard_rows=shard_rows)
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected)
