"""A stream into a collection keeps each id once, across replayed files and restarts."""

import uuid

from complaintlens.sources import collection
from complaintlens.streaming import ingest


def export(spark, path, rows, mode="append"):
    frame = spark.createDataFrame(rows, "chunk_id string, chunk_text string, embedding array<float>")
    frame.coalesce(1).write.mode(mode).parquet(path)


def test_replays_and_restarts_keep_each_id_once(spark, tmp_path):
    source = str(tmp_path / "export")
    first = [(f"c{i}", f"text {i}", [1.0, float(i), 0.0]) for i in range(20)]
    export(spark, source, first, "overwrite")
    export(spark, source, [("c1", "other", [0.0, 1.0, 0.0]), ("c20", None, [1.0, 1.0, 1.0]), ("c20", "b", [2.0, 1.0, 1.0])])
    schema = spark.read.parquet(source).schema
    name, home, checkpoint = f"once_{uuid.uuid4().hex}", str(tmp_path / "home"), str(tmp_path / "checkpoint")
    run = lambda: ingest.ingest_collection_stream(spark, source, name, schema, 3, home, checkpoint, files_per_batch=1).awaitTermination()
    run()
    # A restart with a replayed file and a new one.
    export(spark, source, first[:5])
    export(spark, source, [("c21", "new", [0.0, 0.0, 1.0]), ("c2", "late", [5.0, 5.0, 5.0])])
    run()
    got = {r.chunk_id: r.chunk_text for r in spark.table(name).collect()}
    assert len(got) == spark.table(name).count() == 22
    assert got["c1"] == "text 1" and got["c2"] == "text 2" and got["c21"] == "new" and got["c20"] in ("", "b")

    # The same as write_collection over the files in order.
    reference = f"ref_{uuid.uuid4().hex}"
    files = sorted(p for p in (tmp_path / "export").glob("*.parquet"))
    for number, path in enumerate(sorted(files, key=lambda p: p.stat().st_mtime)):
        batch = ingest.checked_index(spark.read.parquet(str(path)), 3)
        collection.write_collection(batch, reference, str(tmp_path / "ref"), reset=number == 0)
    want = {r.chunk_id: (r.chunk_text, tuple(r.embedding)) for r in spark.table(reference).collect()}
    assert {r.chunk_id: (r.chunk_text, tuple(r.embedding)) for r in spark.table(name).collect()} == want
