"""Top values from frequent-value summaries equal the full count, proven or counted in full."""

import numpy as np
import pytest

from complaintlens.operators import dashboard, frequent


@pytest.mark.parametrize("kind", ["skewed", "flat", "hot"])
def test_equal_to_full_count(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "skewed":
        values = rng.zipf(1.3, 20_000) % 5000
    elif kind == "flat":
        values = rng.integers(0, 3000, 20_000)
    else:
        values = np.where(rng.random(20_000) < 0.34, 7, rng.integers(0, 50_000, 20_000))
    rows = [(f"v{v}" if i % 97 else None,) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "company string").repartition(9)
    for n in (1, 10, 40):
        got = [tuple(r) for r in frequent.top_frequent(df, "company", n, capacity=50).collect()]
        assert got == [tuple(r) for r in dashboard.top_values(df, "company", n).collect()]


def test_few_values_and_empty(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "company string")
    assert [tuple(r) for r in frequent.top_frequent(df, "company", 5).collect()] == [("a", 2, 1), ("b", 1, 2)]
    empty = spark.createDataFrame([], "company string")
    assert frequent.top_frequent(empty, "company", 3).count() == 0
