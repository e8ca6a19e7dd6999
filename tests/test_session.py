import pytest
from pyspark.sql import functions as F

from complaintlens import session


def test_scratch_is_below_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = session.scratch_dir(spark, "x"), session.scratch_dir(spark, "x")
    assert one != two and one.startswith(f"{root}/x-")


def test_a_cluster_must_name_the_folder():
    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster(), "x")


def test_local_only_up_to_the_bound(spark):
    assert session.local_if_small(spark.range(10), 9) is None
    assert session.local_if_small(spark.range(10), 10).count() == 10


@pytest.mark.parametrize("bound, small", [(9, False), (10, True)])
def test_settled_computes_once(spark, bound, small):
    df = spark.range(10).withColumn("x", F.rand())
    kept, fits = session.settled(df, "test", bound)
    assert fits is small and kept.count() == 10
    assert kept.collect() == kept.collect()


def test_spread(spark):
    few = spark.range(100).coalesce(1)
    assert session.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(16)
    assert session.spread(many, "id") is many
