"""Clustered vectors: the search reads fewer clusters and gives the rows of the full search."""

import numpy as np

from complaintlens.operators import pruned, retrieval


def test_equal_rows_and_fewer_clusters(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 4000)] + 0.05 * rng.normal(size=(4000, 16))).astype(np.float32)
    vectors[7] = 0.0
    vectors[8] = vectors[9]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>").repartition(4)
    asked = [(q, (vectors[q] + 0.01 * rng.normal(size=16)).tolist()) for q in (1, 9, 100, 2000)]
    questions = spark.createDataFrame(asked, "question_id long, question_vec array<double>")
    path = str(tmp_path / "clustered")
    pruned.write_clustered(table, path, 16, pivots=24)
    for k in (1, 5, 50):
        hits, read, total = pruned.search_clustered(spark, path, questions, k, 16)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, retrieval.retrieve(table, questions, k, 16).collect()))
        assert read < total
