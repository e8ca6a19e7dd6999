"""Metadata laid out by key range: pushed key filters, and few row groups can hold a key."""

import glob

import pyarrow.parquet as pq

from complaintlens.sources import lookup


def test_layout_and_pushed_filter(spark, tmp_path):
    df = spark.range(0, 200_000).selectExpr("id * 7 AS chunk_id", "repeat('x', 50) AS text").repartition(16)
    path = str(tmp_path / "meta")
    lookup.write_lookup_table(df, path, "chunk_id", rows_per_file=20_000)
    wanted = [7 * 5, 7 * 123_456, 7 * 199_999, 3]
    found = lookup.lookup(spark, path, "chunk_id", wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chunk_id, [" in plan
    assert sorted(r.chunk_id for r in found.collect()) == sorted(wanted[:3])
    groups = [(f, g) for f in glob.glob(f"{path}/*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
    covering = 0
    for f, g in groups:
        stats = pq.ParquetFile(f).metadata.row_group(g).column(0).statistics
        covering += any(stats.min <= k <= stats.max for k in wanted)
    assert len(groups) >= 10 and covering <= 3


def test_attach_keeps_hits_without_rows(spark, tmp_path):
    meta = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "chunk_id long, text string")
    path = str(tmp_path / "m")
    lookup.write_lookup_table(meta, path, "chunk_id", files=4)
    hits = spark.createDataFrame([(1, 5, 0.9), (1, 500, 0.8), (2, None, 0.1)], "question_id long, chunk_id long, score double")
    got = sorted((r.question_id, r.chunk_id, r.text) for r in lookup.attach_looked_up(hits, path, "chunk_id").collect())
    assert got == [(1, 5, "t5"), (1, 500, None), (2, None, None)]
