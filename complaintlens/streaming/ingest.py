"""Incremental ingest of vector exports.

Each new file of the export folder is checked, normalised and appended. The work is
stateless, so the table is the same whatever the batch boundaries, and equal to
``build_index`` over all files. Progress and written files are in the checkpoint: a restarted
job goes on where it stopped and writes no row twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from complaintlens.session import scratch_dir
from complaintlens.sources.columns import detect_schema
from complaintlens.sources.exports import ROW_ID, align_to_schema, checked_index, chunk_vectors, row_id

KEPT_REPORTS = 100_000


def vectors_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    width: int,
    normalize: bool = True,
    files_per_batch: int | None = None,
    target: T.StructType | None = None,
    metadata_schema: T.StructType | None = None,
) -> DataFrame:
    """The checked and normalised rows of an export folder as a stream.

    The keys of metadata in JSON texts are only known after reading them all, so their ``metadata_schema``
    must be given. Columns that ``target`` does not have are refused.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(source)
    found = detect_schema(raw.columns)
    if found.nested and not metadata_schema and not isinstance(schema[found.nested].dataType, T.StructType):
        raise ValueError(f"column {found.nested!r} must be a struct to be streamed, or its metadata_schema be given")
    needed = [F.col(f"`{name}`") for name in found.needed()]
    if found.id is None:
        needed.append(row_id())
        found = replace(found, id=ROW_ID)
    raw = raw.select(*needed)
    if found.nested and metadata_schema:
        raw = raw.withColumn(found.nested, F.from_json(F.col(f"`{found.nested}`"), metadata_schema))
    rows = checked_index(chunk_vectors(raw, found), width, normalize)
    if target is None:
        return rows
    if further := [name for name in rows.columns if name not in target.names]:
        raise ValueError(f"the target table has no columns {further}")
    return align_to_schema(rows, target)


def ingest_vectors_stream(
    spark: SparkSession,
    source: str,
    table_path: str,
    schema: T.StructType,
    width: int,
    checkpoint: str | None = None,
    normalize: bool = True,
    files_per_batch: int | None = None,
    target: T.StructType | None = None,
    metadata_schema: T.StructType | None = None,
) -> StreamingQuery:
    """Starts a run over all files not ingested yet; it ends by itself.

    Pass the ``checkpoint`` of the table to go on with it in a later run; without one a new
    folder is used and the run stands alone.
    """
    # Otherwise only the last 100 reports of a run are kept, and its progress would be counted too low.
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(KEPT_REPORTS))
    rows = vectors_stream(spark, source, schema, width, normalize, files_per_batch, target, metadata_schema)
    return (
        rows.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "ingest-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches and rows read so far by a run; refused if it has reported more often than is kept."""
    done = query.recentProgress
    if len(done) >= KEPT_REPORTS:
        raise RuntimeError(f"the run has {KEPT_REPORTS} reports or more; count the rows of the table instead")
    return {"batches": len(done), "rows": sum(int(p["numInputRows"]) for p in done)}


def ingest_collection_stream(
    spark: SparkSession,
    source: str,
    name: str,
    schema: T.StructType,
    width: int,
    path: str | None = None,
    checkpoint: str | None = None,
    key: str = "chunk_id",
    normalize: bool = True,
    files_per_batch: int | None = None,
    metadata_schema: T.StructType | None = None,
) -> StreamingQuery:
    """Starts a run that adds the files not ingested yet to the collection ``name``, each id once; it ends by itself.

    Each micro-batch goes through ``collection.write_collection``: the first creates the collection, later ones append only
    ids it does not hold (of rows that repeat an id in a batch, the one of smallest content hash). So the collection is that
    of ``write_collection`` over the batches in order: a replayed file, or a batch run again after a restart, adds nothing, and
    an id keeps the row of the first batch that brought it. The append meets the stored ids through the buckets of the
    collection, without shuffling the stored table. Pass the ``checkpoint`` of the collection to go on with it in a later run.
    """
    from complaintlens.sources.collection import write_collection

    rows = vectors_stream(spark, source, schema, width, normalize, files_per_batch, None, metadata_schema)

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        exists = batch.sparkSession.catalog.tableExists(name)
        write_collection(batch, name, path, reset=not exists, key=key)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "collection-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )


class RunTotals:
    """Rows and observed checks of streaming runs, summed from progress events as they come; nothing is kept per batch.

    ``attach`` registers it with the session's streams; ``of(query)`` gives a run's totals.
    """

    def __init__(self) -> None:
        from pyspark.sql.streaming import StreamingQueryListener

        totals: dict[str, dict[str, int]] = {}
        self.totals = totals

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                totals.setdefault(str(event.id), {"batches": 0, "rows": 0})

            def onQueryProgress(self, event) -> None:
                done = totals.setdefault(str(event.progress.id), {"batches": 0, "rows": 0})
                done["batches"] += 1
                done["rows"] += int(event.progress.numInputRows)
                for metrics in event.progress.observedMetrics.values():
                    for name, value in metrics.asDict().items():
                        done[name] = done.get(name, 0) + int(value or 0)

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                totals.setdefault(str(event.id), {"batches": 0, "rows": 0})["ended"] = 1

        self.listener = Listener()

    def attach(self, spark: SparkSession) -> RunTotals:
        spark.streams.addListener(self.listener)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self.listener)

    def of(self, query: StreamingQuery, wait_s: float = 60.0) -> dict[str, int]:
        """The totals of ``query``; after it ended, once its last events have come (events come after the run, in order)."""
        import time

        until = time.monotonic() + wait_s
        while not query.isActive and not self.totals.get(str(query.id), {}).get("ended") and time.monotonic() < until:
            time.sleep(0.05)
        found = dict(self.totals.get(str(query.id), {"batches": 0, "rows": 0}))
        found.pop("ended", None)
        return found


def observed_stream(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """``rows`` with the checks of ``width_violations`` observed in every micro-batch (name ``checks``)."""
    from complaintlens.sources.exports import vector_checks

    return rows.observe("checks", *vector_checks(width, vector))
