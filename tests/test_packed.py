"""Packed vector blocks give the rows of the exact search in double."""

import numpy as np

from complaintlens.operators import packed, retrieval


def frames(spark, random_vectors, n=3000, width=48):
    vectors = random_vectors(n, width, seed=4)
    vectors[10] = vectors[11]  # a copy: a tie broken by id
    vectors[12] = 0.0  # a zero vector
    vectors[20:40] = vectors[20] * 1.0000001  # near ties in float32
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    questions = spark.createDataFrame([(q, vectors[q].tolist()) for q in (0, 10, 20, 25, 12)], "question_id long, question_vec array<float>")
    return table, questions, vectors


def test_blocks_equal_the_exact_search(spark, random_vectors, tmp_path):
    table, questions, _ = frames(spark, random_vectors)
    path = str(tmp_path / "blocks")
    packed.pack_vectors(table, width=48, block_rows=256).write.option("compression", "none").parquet(path)
    blocks = spark.read.parquet(path)
    assert blocks.count() >= 12
    for k in (1, 5, 30):
        got = sorted(map(tuple, packed.search_packed(blocks, questions, k, 48).collect()))
        want = sorted(map(tuple, retrieval.retrieve(table, questions, k, 48).collect()))
        assert got == want


def test_one_question(spark, random_vectors, tmp_path):
    table, _, vectors = frames(spark, random_vectors)
    path = str(tmp_path / "blocks1")
    packed.pack_vectors(table, width=48, block_rows=100).write.parquet(path)
    for q in (vectors[20], vectors.mean(axis=0)):
        got = [tuple(r) for r in packed.top_k_packed_single(spark.read.parquet(path), q, k=7).collect()]
        assert got == [tuple(r) for r in retrieval.top_k_single(table, q, k=7).collect()]


def test_bound_covers_float32_error():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 384)).astype(np.float32)
    q = rng.normal(size=384)
    q /= np.linalg.norm(q)
    exact = (v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]) @ q
    rough = (v @ q.astype(np.float32)) / np.linalg.norm(v.astype(np.float64), axis=1)
    assert np.abs(rough - exact).max() < packed.error_bound(384) / 4
