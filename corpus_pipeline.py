"""Preparing a training corpus: quality filter, near-duplicates, repeated passages, benchmark passages, source mix.

Each stage gets the documents that the one before it kept, written as Parquet and read back, so a lost executor or a
failed stage costs that stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.llm import decontamination, mixing, near_duplicates, quality, repeats
from complaintlens.llm.registry import table
from complaintlens.session import written_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    The groups are those of the SimHash near-dedup operator with its contract's parameters: fingerprints of 4-word shingles
    that link at 4 or fewer differing bits, components by links; no word-similarity check beside the bit distance.
    """
    return near_duplicates.keep_one_of_each(docs.select(*COLUMNS), width=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occur elsewhere.

    A character that lost some of its bytes becomes U+FFFD. A document that lost all its text stays, empty.
    """
    cut = repeats.remove_repeats(docs, keep=("lang", "source"))
    cut = cut.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found, told apart by id and text."""
    return decontamination.drop_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes something, with the words taken; a text is used ``taken / size`` times."""
    return mixing.mix_sources(docs, keep=("text", "lang", "n_chars")).filter("taken > 0")


STAGES = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix),
]

# The trees of the first stage cannot be written in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
