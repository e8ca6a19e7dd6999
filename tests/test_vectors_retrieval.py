import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from complaintlens.functions import vectors as V
from complaintlens.operators import embedding, retrieval
from complaintlens.plans import vector_queries

WIDTH = 16


def table(spark, vectors, ids=None):
    rows = [(i, f"text {i}", [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "chunk_id long, chunk_text string, embedding array<float>")


def asked(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "question_id long, question_vec array<float>")


def brute_force(vectors, questions, k):
    def unit(m):
        m = np.asarray(m, "float32").astype("float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(questions) @ unit(vectors).T, 9)
    out = {}
    for q, row in enumerate(scores):
        out[q] = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
    return out


def ids_of(hits):
    found = {}
    for r in hits.orderBy("question_id", "rank").collect():
        found.setdefault(r.question_id, []).append(r.chunk_id)
    return found


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(V.norm(a), V.l2_normalize(a), V.dot(a, b), V.cosine(a, b)).collect()
    assert tuple(rows[0]) == (5.0, [0.6, 0.8], 3.0, pytest.approx(0.6))
    assert tuple(rows[1]) == (0.0, [0.0, 0.0], 0.0, 0.0)


def test_length_is_computed_once_per_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(V.l2_normalize(F.col("v")).alias("u"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1


def test_check_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>")
    with pytest.raises(Exception, match="expected vectors of width 2, found width 1"):
        df.select(V.check_width(F.col("v"), 2)).collect()
    good = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert good.select(V.check_width(F.col("v"), 2).alias("v")).first().v == [1.0, 2.0]
    with pytest.raises(Exception, match="found width no"):
        spark.sql("SELECT CAST(NULL AS array<float>) AS v").select(V.check_width(F.col("v"), 2)).collect()


def test_exact_match_comes_first(spark, random_vectors):
    vectors = random_vectors(10)
    hits = retrieval.retrieve(table(spark, vectors), asked(spark, vectors[7:8]), k=1).first()
    assert hits.chunk_id == 7 and hits.score > 0.999


def test_hits_are_sorted_and_k_may_exceed_n(spark, random_vectors):
    vectors = random_vectors(5)
    rows = retrieval.retrieve(table(spark, vectors), asked(spark, vectors[:1]), k=100).orderBy("rank").collect()
    assert len(rows) == 5
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("bound", [retrieval.MAX_QUESTION_BYTES, 0])
def test_both_ways_equal_brute_force(spark, random_vectors, partitions, bound, monkeypatch):
    vectors, questions = random_vectors(300, WIDTH), random_vectors(9, WIDTH, 1)
    hits = retrieval.retrieve(
        table(spark, vectors).repartition(partitions), asked(spark, questions), 4, WIDTH, max_question_bytes=bound
    )
    assert ids_of(hits) == brute_force(vectors, questions, 4)


@pytest.mark.parametrize("bound", [retrieval.MAX_QUESTION_BYTES, 0])
def test_a_third_of_the_rows_are_copies(spark, random_vectors, bound):
    vectors = random_vectors(240, WIDTH)
    vectors[::3] = vectors[0]
    vectors[5] = 0.0
    hits = retrieval.retrieve(
        table(spark, vectors).repartition(5), asked(spark, vectors[[0, 1, 5]]), 7, WIDTH, max_question_bytes=bound
    )
    assert ids_of(hits) == brute_force(vectors, vectors[[0, 1, 5]], 7)


def test_small_arrow_batches(spark, random_vectors):
    vectors, questions = random_vectors(200, WIDTH), random_vectors(3, WIDTH, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        hits = retrieval.retrieve(table(spark, vectors).coalesce(1), asked(spark, questions), 20, WIDTH)
        assert ids_of(hits) == brute_force(vectors, questions, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_string_ids(spark, random_vectors):
    vectors = random_vectors(50, WIDTH)
    named = table(spark, vectors).withColumn("chunk_id", F.concat_ws("_", "chunk_id", F.lit("0")))
    hits = retrieval.retrieve(named, asked(spark, vectors[:2]), 1, WIDTH).orderBy("question_id").collect()
    assert [h.chunk_id for h in hits] == ["0_0", "1_0"]


def test_single_question_equals_batch(spark, random_vectors):
    vectors = random_vectors(80, WIDTH)
    stored = table(spark, vectors)
    one = [r.chunk_id for r in retrieval.top_k_single(stored, vectors[4], k=6).collect()]
    assert one == brute_force(vectors, vectors[4:5], 6)[0]
    assert one == ids_of(retrieval.retrieve(stored, asked(spark, vectors[4:5]), 6, WIDTH))[0]


def test_wrong_width_fails(spark, random_vectors):
    vectors = random_vectors(5, 8)
    with pytest.raises(Exception, match="width"):
        retrieval.retrieve(table(spark, vectors), asked(spark, random_vectors(1, WIDTH)), 1, WIDTH).collect()
    with pytest.raises(ValueError, match="width"):
        retrieval.retrieve(table(spark, vectors), asked(spark, vectors), 1, WIDTH)
    with pytest.raises(Exception, match="width"):
        retrieval.top_k_single(table(spark, vectors), random_vectors(1, WIDTH)[0]).collect()
    with pytest.raises(ValueError, match="k must"):
        retrieval.retrieve(table(spark, vectors), asked(spark, vectors), 0, 8)


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
@pytest.mark.parametrize("place", [0, 20, 39])
def test_a_vector_that_is_not_finite_stops_a_search(spark, random_vectors, bad, place):
    vectors = random_vectors(40, WIDTH)
    questions = asked(spark, vectors[:2])
    vectors[place, 3] = bad
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stored = table(spark, vectors).coalesce(1)
        with pytest.raises(Exception, match="not finite"):
            retrieval.retrieve(stored, questions, 3, WIDTH).collect()
        with pytest.raises(Exception, match="not finite"):
            retrieval.top_k_single(stored, random_vectors(1, WIDTH)[0], k=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slices_of_questions_give_the_same_and_shuffle_no_vector(spark, random_vectors):
    vectors = random_vectors(60, WIDTH)
    stored, questions = table(spark, vectors), asked(spark, vectors[:9])
    whole = retrieval.retrieve(stored, questions, 4, WIDTH)
    sliced = retrieval.retrieve(stored, questions, 4, WIDTH, max_question_bytes=2 * 8 * WIDTH)
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, whole.collect()))
    assert "embedding" not in sliced._jdf.queryExecution().executedPlan().toString()


def test_no_vectors_and_no_questions(spark, random_vectors):
    vectors = random_vectors(3, WIDTH)
    assert retrieval.retrieve(table(spark, vectors).limit(0), asked(spark, vectors), 2, WIDTH).count() == 0
    assert retrieval.retrieve(table(spark, vectors), asked(spark, vectors).limit(0), 2, WIDTH).count() == 0


def test_pairs_are_not_shuffled(spark, random_vectors):
    vectors = random_vectors(40, WIDTH)
    hits = retrieval.retrieve(table(spark, vectors), asked(spark, vectors[:3]), 2, WIDTH)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("Exchange") == 1
    assert "WindowGroupLimit" in plan


def test_attach_metadata_keeps_hits_without_any(spark, monkeypatch):
    hits = spark.createDataFrame([(0, 1, 0.5, 1), (0, 9, 0.4, 2)], "question_id long, chunk_id long, score double, rank int")
    meta = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "chunk_id long, company string")
    expected = {1: "c1", 9: None}
    assert dict(retrieval.attach_metadata(hits, meta).select("chunk_id", "company").collect()) == expected
    monkeypatch.setattr(retrieval, "settled", lambda df, purpose: (df, False))
    assert dict(retrieval.attach_metadata(hits, meta).select("chunk_id", "company").collect()) == expected


def test_self_retrieval(spark, random_vectors):
    stored = table(spark, random_vectors(30, WIDTH))
    rows = retrieval.self_retrieval(stored, stored.filter("chunk_id % 5 = 0"), WIDTH).collect()
    assert len(rows) == 6 and all(r.found_itself for r in rows)


def test_self_retrieval_query_asks_no_fewer_than_a_sample_of_50(spark, random_vectors, tmp_path):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(random_vectors(120, 64))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_queries.self_retrieval(spark, str(tmp_path)).collect()
    asked = [r.question_id for r in found]
    assert len(asked) == len(set(asked)) >= 50 and {0, 50, 100} <= set(asked)
    assert all(r.found_itself for r in found)


def test_embedder_is_handed_long_texts_in_small_parts(spark):
    class Counting:
        def embed(self, texts):
            return np.array([[1.0, len(texts)]] * len(texts))

    df = spark.createDataFrame([(i, "x" * 100_000) for i in range(40)], "id long, t string").coalesce(1)
    vectors = [r.embedding for r in embedding.embed(df, "t", Counting).collect()]
    assert len(vectors) == 40 and max(round(b / a) for a, b in vectors) <= 11


def test_search_scores_few_rows_of_a_batch_at_once(spark, random_vectors):
    data = random_vectors(5_000, WIDTH)
    stored = table(spark, data).coalesce(1)
    questions = data[:3].astype("float64")
    plain = retrieval.BestHits(4, retrieval.unit_matrix(pa.array(questions.tolist()), WIDTH))
    plain.add(pa.array(range(5_000)), retrieval.unit_matrix(pa.array(data.tolist()), WIDTH))
    hits = retrieval.retrieve(stored, asked(spark, questions), 4, WIDTH).collect()
    wanted = {(q, i): s for q, i, s in zip(plain.hits["q"], plain.hits["id"], plain.hits["score"])}
    assert {(r.question_id, r.chunk_id): r.score for r in hits} == pytest.approx(wanted) and retrieval.BLOCK_ROWS < 5_000


def test_hashed_embedder(spark):
    texts = [(1, "fee fee card"), (2, ""), (3, None), (4, "card")]
    df = spark.createDataFrame(texts, "id long, t string")
    rows = {r.id: r.embedding for r in embedding.embed(df, "t", embedding.hashed(WIDTH)).collect()}
    assert rows[3] is None and sum(map(abs, rows[2])) == 0
    assert math.isclose(np.linalg.norm(rows[1]), 1.0, rel_tol=1e-6)
    counts = {}
    for r in embedding.hashed_buckets(df, "id", "t", WIDTH).collect():
        counts.setdefault(r.id, {})[r.bucket] = r.n
    assert set(counts) == {1, 4}
    for key, buckets in counts.items():
        vector = np.zeros(WIDTH)
        vector[list(buckets)] = list(buckets.values())
        assert np.allclose(rows[key], vector / np.linalg.norm(vector), atol=1e-6)


def test_injected_embedder_is_loaded_per_worker_and_normalised(spark):
    class Fixed:
        def embed(self, texts):
            assert len(texts) <= 2
            return np.array([[3.0, 4.0]] * len(texts))

    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "t string").coalesce(1)
    rows = [r.embedding for r in embedding.embed(df, "t", Fixed, batch=2).collect()]
    assert rows[2] is None and np.allclose([r for r in rows if r], [[0.6, 0.8]] * 3)


def test_large_ids_stay_exact_and_null_ids_are_refused(spark):
    import pytest

    big = [(2**53 + 1, [1.0, 0.0]), (2**60 + 7, [0.9, 0.1]), (3, [0.0, 1.0])]
    table = spark.createDataFrame(big, "chunk_id long, embedding array<float>")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, question_vec array<double>")
    assert [r.chunk_id for r in retrieval.retrieve(table, questions, 2, 2).orderBy("rank").collect()] == [2**53 + 1, 2**60 + 7]
    nulls = spark.createDataFrame(big + [(None, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    with pytest.raises(Exception, match="without an id"):
        retrieval.retrieve(nulls, questions, 2, 2).collect()
