"""Checks counted by the writing jobs equal those of a second pass."""

from complaintlens.sources import exports
from complaintlens.streaming import ingest


def test_batch_and_stream_observations(spark, tmp_path, random_vectors):
    vectors = random_vectors(50, 4).tolist()
    vectors[3] = vectors[3][:3]
    vectors[5][0] = float("nan")
    rows = [(i, v) for i, v in enumerate(vectors)] + [(99, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    figures = exports.write_observed(df, str(tmp_path / "out"), 4)
    assert figures == exports.width_violations(df, 4).first().asDict()

    totals = ingest.RunTotals().attach(spark)
    stream = ingest.observed_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "out")), 4)
    run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = totals.of(run)
    totals.detach(spark)
    assert found["rows"] == figures["n_vectors"] == 51
    # The null vector counts as of another width, the NaN as not finite.
    assert (found["n_wrong_width"], found["n_non_finite"]) == (figures["n_wrong_width"], figures["n_non_finite"]) == (2, 1)
    assert found["batches"] >= 1
