"""CSV files read in byte ranges equal the single-task multi-line read."""

import random

import pytest

from complaintlens.sources import complaints, split_csv

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write_one_file(spark, path, rows):
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    frame.coalesce(1).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def test_one_file_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        text = " ".join(rng.choice(["x", "y\nz", '"q"', "r,s", "\r\n", "", "NA", "long" * 50]) for _ in range(rng.randrange(0, 8)))
        rows.append((str(i), text, rng.choice(["u", None, "v\nw"])))
    # Cells that span several byte ranges, one of them with nothing but quoted lines.
    rows.append(("big", "line\n" * 12000, "end"))
    rows.append(("quoted", '"\n' * 15000, "x"))
    path = str(tmp_path / "one")
    write_one_file(spark, path, rows)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() >= 8
    got = sorted(map(tuple, split_csv.read_csv_split(spark, path, COLUMNS).collect()), key=repr)
    want = sorted(map(tuple, complaints.read_complaints_csv(spark, path, COLUMNS).collect()), key=repr)
    assert got == want and len(got) == 3002


def test_wrong_header_and_cells_fail(spark, tmp_path, small_ranges):
    path = str(tmp_path / "two")
    write_one_file(spark, path, [("1", "x", "y")])
    with pytest.raises(Exception, match="header"):
        split_csv.read_csv_split(spark, path, ["a", "b", "d"]).collect()
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.csv").write_text('a,b,c\n1,"x\ny",z\n2,only\n')
    with pytest.raises(Exception):
        split_csv.read_csv_split(spark, str(bad), COLUMNS).collect()


def test_empty_file_and_blank_lines(spark, tmp_path):
    folder = tmp_path / "blank"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b,c\r\n\r\n1,2,3\r\n\n")
    (folder / "b.csv").write_text("a,b,c\n")
    assert [tuple(r) for r in split_csv.read_csv_split(spark, str(folder), COLUMNS).collect()] == [("1", "2", "3")]
