import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from complaintlens.operators.sampling import sampling_summary, stratified_sample, stratified_targets


@pytest.fixture
def strata(spark):
    rows = [(i, c) for i, c in enumerate("A" * 400 + "B" * 300 + "C" * 100)]
    return spark.createDataFrame(rows, "value long, category string").repartition(6)


def drawn(df, n, **options):
    return stratified_sample(df, "category", n, "value", **options)


def brute_force(rows, n, seed):
    counts = Counter(c for _, c in rows if c is not None)
    total = sum(counts.values())
    kept = set()
    for category, size in counts.items():
        target = min(round(size / total * n), size)
        ids = [i for i, c in rows if c == category]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        kept |= set(ids[:target])
    return kept


def test_proportions_and_size(strata):
    counts = dict(drawn(strata, 80, seed=0).groupBy("category").count().collect())
    assert counts == {"A": 40, "B": 30, "C": 10}


def test_never_more_than_there_is(strata):
    sample = drawn(strata, 10_000)
    assert sample.count() == 800


def test_no_row_twice(strata):
    sample = drawn(strata, 80)
    assert sample.select("value").distinct().count() == sample.count() == 80


@pytest.mark.parametrize("slices, max_ranked", [(1, 10), (3, 1), (1024, 10_000), (16, 2)])
def test_rows_are_the_first_by_hash_whatever_the_slices(strata, slices, max_ranked):
    rows = [tuple(r) for r in strata.collect()]
    for n in (7, 399):
        found = {r.value for r in drawn(strata, n, seed=5, slices=slices, max_ranked=max_ranked).collect()}
        assert found == brute_force(rows, n, 5)


def test_partitioning_does_not_matter_and_seed_does(strata):
    first = {r.value for r in drawn(strata, 80).collect()}
    assert first == {r.value for r in drawn(strata.coalesce(1), 80).collect()}
    assert first != {r.value for r in drawn(strata, 80, seed=1).collect()}


def test_skewed_category_and_nulls(spark):
    rows = [(i, "hot" if i % 10 else ("cold" if i % 20 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "value long, category string")
    found = {r.value for r in drawn(df, 500).collect()}
    assert found == brute_force(rows, 500, 42)


def test_too_many_quotas_for_a_broadcast(strata, monkeypatch):
    from complaintlens import session
    from complaintlens.operators import sampling

    expected = {r.value for r in drawn(strata, 80).collect()}
    monkeypatch.setattr(sampling, "settled", lambda df, purpose: (session.written_once(df, purpose), False))
    assert {r.value for r in drawn(strata, 80).collect()} == expected


def test_rows_without_a_key_count_too(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (2, "b")], "value long, category string")
    assert drawn(df, 4).count() == 4


def test_only_keys_and_hashes_are_ranked(spark):
    df = spark.range(20_000).selectExpr("id AS value", "'one' AS category", "repeat('x', 50) AS words")
    sample = drawn(df, 500, slices=64, max_ranked=50)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    rows = [(r.value, "one") for r in df.collect()]
    assert {r.value for r in sample.collect()} == brute_force(rows, 500, 42)


def test_shuffle_keeps_the_rows(strata):
    plain, mixed = drawn(strata, 80), drawn(strata, 80, shuffle=True)
    assert {r.value for r in plain.collect()} == {r.value for r in mixed.collect()}
    assert [r.value for r in mixed.collect()] != sorted(r.value for r in mixed.collect())
    assert mixed.columns == strata.columns


def test_zero_target_is_empty(strata):
    assert drawn(strata, 0).count() == 0


def test_unknown_column_is_refused(strata):
    with pytest.raises(ValueError, match="nothing"):
        stratified_sample(strata, "nothing", 5, "value")
    with pytest.raises(ValueError, match="nothing"):
        stratified_targets(strata, "nothing", 5)


def test_targets_round_to_even(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "value long, category string")
    assert {r.target for r in stratified_targets(df, "category", 5).collect()} == {2}


def test_summary(strata):
    summary = sampling_summary(strata, drawn(strata, 80), "category").collect()
    assert [tuple(r) for r in summary] == [
        ("A", 400, 40, 50.0, 50.0), ("B", 300, 30, 37.5, 37.5), ("C", 100, 10, 12.5, 12.5),
    ]
    partial = sampling_summary(strata, strata.filter(F.col("category") != "C"), "category").collect()
    assert [r.sample_n for r in partial] == [400, 300, None]


@pytest.mark.parametrize("fanout", [2, 8])
def test_bottom_k_lists_give_the_rows_of_the_slices(spark, fanout):
    rows = [(i % 350 if i % 7 else None, c, f"t{i % 11}") for i, c in enumerate("A" * 400 + "B" * 300 + "C" * 100 + "D" * 3)]
    df = spark.createDataFrame(rows, "value long, category string, text string").repartition(13)
    for n in (1, 37, 500, 5000):
        by_lists = sorted(map(tuple, stratified_sample(df, "category", n, "value", seed=3, fanout=fanout).collect()), key=repr)
        by_slices = sorted(map(tuple, stratified_sample(df, "category", n, "value", seed=3, slices=16, max_ranked=20).collect()), key=repr)
        assert by_lists == by_slices and (by_lists or n == 1)


def test_counting_scans_read_key_and_category_only(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([(i, "A" if i % 3 else "B", "x" * 50, 1.5) for i in range(200)], "value long, category string, text string, w double").write.parquet(path)
    sample = stratified_sample(spark.read.parquet(path), "category", 20, "value")
    from complaintlens.operators import sampling

    plan = sampling._narrow(spark.read.parquet(path), "category", "value", 42)._jdf.queryExecution().executedPlan().toString()
    schemas = [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]
    # The keyed branch reads two columns; the branch of rows without a key reads all, but only rows with a null key.
    assert "struct<value:bigint,category:string>" in schemas
    assert "IsNull(value)" in plan
    assert sample.count() == 20
