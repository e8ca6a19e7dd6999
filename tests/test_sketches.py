"""Distinct counts from period sketches: exact when small, within the stated error when large, and updatable."""

from pyspark.sql import functions as F

from complaintlens.operators import dashboard, sketches


def test_small_counts_are_exact_and_equal_kpis(spark):
    rows = [(i % 4 if i % 9 else None, f"c{i % 37}", f"s{i % 11}", i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "product_category int, company string, state string, day int")
    df = df.withColumn("product_category", F.col("product_category").cast("string"))
    got = sketches.kpis_sketched(sketches.period_sketches(df, "day", ["product_category", "company", "state"])).first()
    assert tuple(got) == tuple(dashboard.kpis(df).first())


def test_large_counts_within_the_bound_and_updates_without_rereading(spark, tmp_path):
    df = spark.range(0, 300_000).select((F.col("id") % 120_000).alias("user"), (F.col("id") % 30).alias("day"))
    path = str(tmp_path / "sketches")
    sketches.period_sketches(df.filter("day < 20"), "day", ["user"]).write.parquet(path)
    sketches.period_sketches(df.filter("day >= 20"), "day", ["user"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    total = sketches.united(stored, ["user"]).first()
    assert total.n_rows == 300_000
    assert abs(total.n_user - 120_000) <= 3 * sketches.relative_error() * 120_000
    some = sketches.united(stored, ["user"], where=F.col("period") < 10).first()
    exact = df.filter("day < 10").agg(F.count_distinct("user")).first()[0]
    assert abs(some.n_user - exact) <= 3 * sketches.relative_error() * exact


def test_empty(spark):
    empty = spark.createDataFrame([], "company string, day int")
    assert tuple(sketches.united(sketches.period_sketches(empty, "day", ["company"]), ["company"]).first()) == (0, 0)
