"""Queries for periodic runs, importance resampling and exact top-k search."""

from __future__ import annotations

from complaintlens.llm import periodic, resampling, topk
from complaintlens.llm.registry import query, table

TOP_K_SQL = r"""
WITH v AS (
  SELECT vec_id, embedding AS e, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR NOT (abs(x::DOUBLE) < 16384))) = 0),
w AS (SELECT vec_id, rid, len(e) AS width, list_transform(e, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM v),
pairs AS (SELECT q.vec_id AS query_id, q.rid AS qrid, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM w q JOIN w c ON q.width = c.width AND q.rid <> c.rid WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs)
WHERE rank <= 20
"""


@query("op13_exact_top_k", TOP_K_SQL)
def exact_top_k(spark, folder):
    return topk.exact_top_k(table(spark, folder, "embeddings"), k=20, every=20, scale=64.0)


@query("op12_importance_resample")
def importance_resample(spark, folder):
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return resampling.importance_sample(docs, target, max_words=1, buckets=10_000, share_percent=10, min_words=20, seed="2024")


@query("op11_periodic_runs")
def periodic_runs(spark, folder):
    return periodic.periodic_runs(table(spark, folder, "documents"))
