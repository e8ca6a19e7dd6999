import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from complaintlens.functions.text import PRODUCTS
from complaintlens.sources import collection, columns, complaints, exports
from complaintlens.streaming import ingest

WIDTH = 384
NESTED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("complaint_id", T.LongType()),
                    *[T.StructField(n, T.StringType()) for n in ("product_category", "company", "issue")],
                ]
            ),
        ),
    ]
)


def nested(spark, vectors, start=0):
    rows = [
        (f"case-{i}/1", f"narrative of case {i}", [float(x) for x in v], (i, PRODUCTS[i % 4], f"lender {i % 3}", None))
        for i, v in enumerate(vectors, start)
    ]
    return spark.createDataFrame(rows, NESTED)


def flat(spark, vectors, text="chunk_text", vector="embedding"):
    rows = [(i, f"text {i}", PRODUCTS[i % 4], [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(
        rows, f"complaint_id long, {text} string, product_category string, {vector} array<float>"
    )


def saved(df, path, parts=1):
    df.repartition(parts).write.parquet(str(path))
    return str(path)


# --- names -----------------------------------------------------------------


def test_normal_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Complaint ID ` int, `Date (received)` int, `Sub-issue?` int")
    assert columns.normalize_columns(df).columns == ["complaint_id", "date_received", "sub_issue"]
    clash = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    with pytest.raises(ValueError, match="a_b"):
        columns.normalize_columns(clash)


def test_resolve_column():
    names = ["Company response", "Sub Issue", "Company", "issue"]
    assert columns.resolve_column(names, "company") == "Company"
    assert columns.resolve_column(names, "company", exact_first=False) == "Company response"
    assert columns.resolve_column(names, "issue") == "issue"
    assert columns.resolve_column(names, "missing", "sub_issue") == "Sub Issue"
    with pytest.raises(ValueError, match="state"):
        columns.resolve_column(names, "state")


def test_resolve_exact_column():
    assert columns.resolve_exact_column(["complaint_id", "ID"], "chunk_id", "id") == "ID"
    with pytest.raises(ValueError):
        columns.resolve_exact_column(["complaint_id"], "id")


def test_detect_schema():
    found = columns.detect_schema(["id", "document", "embedding", "metadata", "company"])
    assert (found.text, found.vector, found.id, found.nested, found.flat) == (
        "document", "embedding", "id", "metadata", (),
    )
    found = columns.detect_schema(["text", "vector", "complaint_id", "company", "other"])
    assert (found.text, found.vector, found.id, found.nested) == ("text", "vector", None, None)
    assert found.flat == ("complaint_id", "company")
    assert found.needed() == ["text", "vector", "complaint_id", "company"]
    with pytest.raises(ValueError):
        columns.detect_schema(["text", "complaint_id"])


def test_small_choices(spark):
    df = spark.createDataFrame([(1, "a", "b")], "key int, complaint_id string, product_category string")
    assert columns.id_column_fallback(df) == "complaint_id"
    assert columns.id_column_fallback(df.select("key", "product_category")) == "key"
    assert columns.text_column_fallback(df) == "consumer_complaint_narrative"
    assert columns.text_column_fallback(df.withColumn("clean_narrative", F.lit(""))) == "clean_narrative"
    assert columns.chunk_metadata_columns(df) == ["product_category"]
    with pytest.raises(ValueError, match="product_category"):
        columns.chunk_metadata_columns(df.select("key"))
    with pytest.raises(ValueError):
        columns.find_text_column(df)
    assert columns.find_text_column(df.withColumnRenamed("key", "text")) == "text"
    assert columns.select_existing(df, ["product_category", "none", "key"]).columns == ["product_category", "key"]


def test_rename_complaint_columns(spark):
    df = spark.createDataFrame(
        [(1,) * 8],
        "company_response int, consumer_complaint_narrative int, product int, company int, state int, "
        "date_received int, complaint_id int, issue int",
    )
    found = columns.resolve_complaint_columns(df)
    assert found["company"] == "company" and found["narrative"] == "consumer_complaint_narrative"
    assert columns.resolve_complaint_columns(df, exact_first=False)["company"] == "company_response"
    assert columns.rename_complaint_columns(df).columns == list(columns.COMPLAINT_FIELDS)


# --- CSV -------------------------------------------------------------------


def test_csv_cells_come_back(spark, tmp_path):
    cells = ['say "hi", you', "two\nlines", "  padded ", "NA", "N/A", "null", "", None, "nan", "Nano", "None", "\\"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "id string, text string")
    complaints.write_clean_csv(df, str(tmp_path / "csv"))
    back = {r.id: r.text for r in complaints.read_complaints_csv(spark, str(tmp_path / "csv"), ["id", "text"]).collect()}
    for i, cell in enumerate(cells):
        assert back[str(i)] == (None if cell in complaints.NULL_TOKENS else cell)
    assert complaints.csv_header(spark, str(tmp_path / "csv")) == ["id", "text"]


def test_csv_with_another_header_or_width_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,state,company\n1,NY,Linden\n")
    with pytest.raises(Exception, match="(?i)header"):
        complaints.read_complaints_csv(spark, str(tmp_path / "a.csv"), ["id", "company", "state"]).collect()
    (tmp_path / "b.csv").write_text("id,state\n1,NY,surplus\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        complaints.read_complaints_csv(spark, str(tmp_path / "b.csv"), ["id", "state"]).collect()


# --- index -----------------------------------------------------------------


def test_index_from_nested_export(spark, random_vectors, tmp_path):
    vectors = random_vectors(80)
    index = exports.build_index(spark, saved(nested(spark, vectors), tmp_path / "n"), WIDTH)
    assert set(index.columns) == {
        "chunk_id", "chunk_text", "embedding", "complaint_id", "product_category", "company", "issue",
    }
    rows = {r.complaint_id: r for r in index.collect()}
    assert len(rows) == 80 and rows[3].chunk_id == "case-3/1" and rows[5].company == "lender 2"
    assert np.allclose(np.linalg.norm(rows[3].embedding), 1.0, atol=1e-5)
    assert np.allclose(rows[3].embedding, vectors[3] / np.linalg.norm(vectors[3]), atol=1e-6)
    assert exports.index_count(index).first().n_vectors == 80


def test_index_from_other_names_reads_only_what_it_needs(spark, random_vectors, tmp_path):
    df = flat(spark, random_vectors(20), "text", "vector").withColumn("remark", F.lit("x"))
    index = exports.build_index(spark, saved(df, tmp_path / "f"), WIDTH, normalize=False)
    assert index.columns == ["chunk_text", "embedding", "complaint_id", "product_category", "chunk_id"]
    assert index.select("chunk_id").distinct().count() == 20
    again = exports.build_index(spark, str(tmp_path / "f"), WIDTH, normalize=False)
    assert {tuple(r) for r in index.select("chunk_id", "complaint_id").collect()} == {tuple(r) for r in again.select("chunk_id", "complaint_id").collect()}
    assert "remark" not in index._jdf.queryExecution().executedPlan().toString()


def test_wrong_width_is_refused(spark, random_vectors, tmp_path):
    path = saved(flat(spark, random_vectors(20, 128)), tmp_path / "w")
    with pytest.raises(Exception, match="expected vectors of width 384, found width 128"):
        exports.build_index(spark, path, WIDTH).collect()
    row = exports.width_violations(spark.read.parquet(path), WIDTH).first()
    assert (row.n_vectors, row.n_wrong_width) == (20, 20)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_vectors_that_are_not_finite_are_refused(spark, tmp_path, bad):
    df = spark.createDataFrame([("t", [1.0, 2.0]), ("u", [bad, 1.0])], "text string, vector array<float>")
    path = saved(df, tmp_path / "bad")
    with pytest.raises(Exception, match="not finite"):
        exports.build_index(spark, path, 2).collect()
    assert exports.width_violations(df, 2, "vector").first().n_non_finite == 1


def test_load_embeddings_needs_the_column(spark, tmp_path):
    path = saved(spark.range(3), tmp_path / "x")
    with pytest.raises(ValueError, match="embedding"):
        exports.load_embeddings(spark, path)


def test_vectors_and_metadata_must_agree(spark, random_vectors, tmp_path):
    wide = exports.chunk_vectors(nested(spark, random_vectors(20, 8)), columns.detect_schema(NESTED.names))
    vectors = saved(wide, tmp_path / "v")
    exports.write_metadata(wide, str(tmp_path / "m"))
    left, right = exports.load_index_and_metadata(spark, vectors, str(tmp_path / "m"))
    assert left.count() == right.count() == 20 and "embedding" not in right.columns
    exports.write_metadata(wide.limit(5), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="20 vectors, 5 metadata"):
        exports.load_index_and_metadata(spark, vectors, str(tmp_path / "short"))
    other = wide.withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    exports.write_metadata(other, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="20 keys only with a vector"):
        exports.load_index_and_metadata(spark, vectors, str(tmp_path / "other"))


def test_key_differences_sees_doubled_keys(spark):
    one = spark.createDataFrame([(1,), (2,), (2,)], "chunk_id long")
    two = spark.createDataFrame([(2,), (3,)], "chunk_id long")
    found = {tuple(r) for r in exports.key_differences(one, two).collect()}
    assert found == {(1, 1, 0), (2, 2, 1), (3, 0, 1)}


def test_tables_whose_keys_are_not_equally_frequent_are_refused(spark, tmp_path):
    for name, keys in (("v", "aab"), ("m", "abb")):
        saved(spark.createDataFrame([(k,) for k in keys], "chunk_id string"), tmp_path / name)
    with pytest.raises(ValueError, match="2 not equally often"):
        exports.load_index_and_metadata(spark, str(tmp_path / "v"), str(tmp_path / "m"))


def test_to_metadata(spark):
    df = spark.createDataFrame([("a", "t", [1.0], "c")], "id string, document string, vector array<float>, company string")
    assert exports.to_metadata(df).columns == ["chunk_id", "chunk_text", "company"]
    assert exports.to_metadata(df.drop("vector")).columns == ["chunk_id", "chunk_text", "company"]


# --- metadata --------------------------------------------------------------


def test_expand_json_with_bad_rows_and_differing_keys(spark):
    texts = ['{"a": 1, "b": "x"}', '{"c": {"d": true}}', "not json", "[1, 2]", None, '{"a": 2, "e": null}', "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, meta string")
    rows = exports.expand_metadata(df, "meta").orderBy("id").collect()
    assert set(rows[0].asDict()) == {"id", "a", "b", "c", "e"}
    assert [r.a for r in rows] == [1, None, None, None, None, 2, None]
    assert rows[0].b == "x" and rows[1].c.d is True and all(r.e is None for r in rows)


def test_expand_json_without_any_object(spark):
    df = spark.createDataFrame([(1, "no"), (2, None)], "id int, meta string")
    assert exports.expand_metadata(df, "meta").columns == ["id"]


def test_clashing_keys_are_kept(spark):
    df = spark.createDataFrame([(1, (2, 3, "x"))], "id int, meta struct<ID: int, Id: int, other: string>")
    wide = exports.expand_metadata(df, "meta")
    assert wide.columns == ["id", "meta_ID", "meta_meta_Id", "other"] and tuple(wide.first()) == (1, 2, 3, "x")
    texts = spark.createDataFrame([(1, '{"VOID": 5, "x": null, "o": {"OBJECT": [null]}}')], "id int, meta string")
    row = exports.expand_metadata(texts, "meta").first()
    assert row["VOID"] == 5 and row["x"] is None and row["o"]["OBJECT"] == [None]


def test_fill_metadata(spark):
    df = spark.createDataFrame([(None, None, None)], "a string, b string, n int")
    assert exports.fill_metadata(df).first() == ("", "", None)
    assert exports.fill_metadata(df, ["b"]).first() == (None, "", None)


def test_align_to_schema(spark):
    first = spark.createDataFrame([(1.5, "a")], "x double, s string")
    later = spark.createDataFrame([(7, 1)], "x int, extra int")
    both = exports.append_batches(first, later, spark.createDataFrame([("9", 2.0)], "extra string, y double"))
    assert both.columns == ["x", "s", "extra", "y"]
    assert {tuple(r) for r in both.collect()} == {(1.5, "a", None, None), (7.0, None, 1, None), (None, None, 9, 2.0)}


def test_collection(spark, tmp_path):
    def chunks(*ids):
        return spark.createDataFrame([(i, None, [1.0, 0.0]) for i in ids], "chunk_id string, company string, embedding array<float>")

    path = str(tmp_path / "collection")
    collection.write_collection(chunks("a", "b", "b"), "stored_chunks", path, buckets=2)
    collection.write_collection(chunks("b", "c"), "stored_chunks", reset=False, buckets=2)
    table = spark.table("stored_chunks")
    assert sorted(r.chunk_id for r in table.collect()) == ["a", "b", "c"]
    assert {r.company for r in table.collect()} == {""}
    collection.write_collection(chunks("z"), "stored_chunks", path, buckets=2)
    assert [r.chunk_id for r in spark.table("stored_chunks").collect()] == ["z"]


def test_collection_keeps_new_columns_and_refuses_null_ids(spark, tmp_path):
    path = str(tmp_path / "wider")
    collection.write_collection(spark.createDataFrame([("a", 1)], "chunk_id string, n int"), "wider_chunks", path)
    collection.write_collection(spark.createDataFrame([("b", "NY")], "chunk_id string, state string"), "wider_chunks", reset=False)
    assert {tuple(r) for r in spark.table("wider_chunks").select("chunk_id", "n", "state").collect()} == {("a", 1, None), ("b", None, "NY")}
    with pytest.raises(ValueError, match="without chunk_id"):
        collection.write_collection(spark.createDataFrame([(None, 1)], "chunk_id string, n int"), "wider_chunks", reset=False)
    # A collection can be rewritten from itself.
    collection.write_collection(spark.table("wider_chunks").filter("n = 1"), "wider_chunks", path)
    assert [r.chunk_id for r in spark.table("wider_chunks").collect()] == ["a"]


# --- stream ----------------------------------------------------------------


@pytest.mark.parametrize("files_per_batch", [1, 2, None])
def test_stream_equals_batch(spark, random_vectors, tmp_path, files_per_batch):
    path = saved(nested(spark, random_vectors(130)), tmp_path / "in", parts=3)
    out = str(tmp_path / "out")
    query = ingest.ingest_vectors_stream(spark, path, out, NESTED, WIDTH, files_per_batch=files_per_batch)
    query.awaitTermination()
    assert ingest.progress(query)["rows"] == 130
    key = lambda df: sorted((r.chunk_id, tuple(r.embedding), r.company) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(exports.build_index(spark, path, WIDTH))


def test_stream_goes_on_where_it_stopped(spark, random_vectors, tmp_path):
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    vectors = random_vectors(30)
    nested(spark, vectors[:20]).write.parquet(path)
    ingest.ingest_vectors_stream(spark, path, out, NESTED, WIDTH, checkpoint).awaitTermination()
    nested(spark, vectors[20:], 20).write.mode("append").parquet(path)
    ingest.ingest_vectors_stream(spark, path, out, NESTED, WIDTH, checkpoint).awaitTermination()
    ids = [r.complaint_id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(30))


def test_stream_refuses_wrong_width(spark, random_vectors, tmp_path):
    path = saved(nested(spark, random_vectors(5, 10)), tmp_path / "in")
    query = ingest.ingest_vectors_stream(spark, path, str(tmp_path / "out"), NESTED, WIDTH)
    with pytest.raises(Exception, match="width"):
        query.awaitTermination()


def test_stream_refuses_json_metadata(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, document string, embedding array<float>, metadata string")
    with pytest.raises(ValueError, match="struct"):
        ingest.vectors_stream(spark, str(tmp_path), schema, WIDTH)
