"""JSON metadata kept as VARIANT: no schema pass, streams like batches, keys read later."""

from complaintlens.sources import exports


def test_variant_values_equal_expanded_json(spark, tmp_path):
    rows = [(1, '{"k": 3, "name": "x", "deep": {"a": 1}}'), (2, '{"k": "7"}'), (3, "not json"), (4, None), (5, '{"id": 9, "k": null}')]
    df = spark.createDataFrame(rows, "id long, props string")
    got = exports.metadata_values(exports.metadata_as_variant(df, "props"), "props", {"k": "bigint", "name": "string", "id": "bigint"})
    assert got.columns == ["id", "k", "name", "props_id"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 3, "x", None), (2, 7, None, None), (3, None, None, None), (4, None, None, None), (5, None, None, 9)]


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "json"), str(tmp_path / "variant")
    rows = [(i, f'{{"k": {i}, "tag": "t{i % 3}"}}' if i % 4 else "[1, 2]") for i in range(40)]
    spark.createDataFrame(rows, "id long, props string").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("id long, props string").parquet(source)
    query = exports.metadata_as_variant(stream, "props").writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    keys = {"k": "int", "tag": "string"}
    streamed = exports.metadata_values(spark.read.parquet(target), "props", keys)
    batch = exports.metadata_values(exports.metadata_as_variant(spark.read.parquet(source), "props"), "props", keys)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
