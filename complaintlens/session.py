"""Session construction, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows that may be brought to the driver in order to be broadcast. Callers
# only pass rows of small fixed width (a key, a label, a few numbers).
MAX_BROADCAST_ROWS = 200_000


def build_session(app: str = "complaintlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` keys use ``__`` for dots.

    Without ``master`` the submit-time configuration decides, as on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the Python line of every expression makes plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for ``purpose`` below the shared folder of the cluster.

    The root is ``spark.checkpoint.dir``. Only a local session, whose executors
    share the driver's disk, may go without it and then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="complaintlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def local_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """``df`` computed once and held by the driver, or None if it has more than ``max_rows`` rows.

    At most ``max_rows + 1`` rows are fetched, whatever the size of ``df``.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, df.schema)


def settled(df: DataFrame, purpose: str, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` computed once, and whether it is small enough to be broadcast.

    It is written to the scratch folder. Up to ``max_rows`` rows are then held by the driver; joins with
    more are left to a shuffle, and skew to adaptive execution.
    """
    stored = written_once(df, purpose)
    small = local_if_small(stored, max_rows)
    return (stored, False) if small is None else (small, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions, as from a few small files.

    For work that is heavy per row. A large input has partitions enough and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    For a result that several later steps read: it is computed once, and survives the loss of
    executors.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
