"""Evaluation table: question, answer, first sources, score and comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.functions.text import truncate

# Sources shown per question, width of each, and the headings of the table.
SHOWN_SOURCES = 2
SOURCE_WIDTH = 120
HEADINGS = {
    "question": "Question",
    "answer": "Generated Answer",
    "top_sources": "Retrieved Sources (top 2)",
    "quality_score": "Quality Score (1-5)",
    "comments": "Comments/Analysis",
}
TITLE = "# Qualitative Evaluation"


def eval_table(answers: DataFrame, sources: DataFrame, question_id: str = "question_id") -> DataFrame:
    """One row per question; score null and comment empty, to be filled in by a reader."""
    shown = sources.filter(F.col("rank") <= SHOWN_SOURCES).select(
        question_id,
        "rank",
        F.concat(
            F.lit("["),
            F.coalesce("product_category", F.lit("")),
            F.lit("] "),
            truncate(F.coalesce("chunk_text", F.lit("")), SOURCE_WIDTH),
        ).alias("line"),
    )
    lines = (
        shown.groupBy(question_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_lines"))
        .select(question_id, F.array_join(F.col("_lines.line"), " | ").alias("_top"))
    )
    return answers.join(lines, question_id, "left").select(
        question_id,
        "question",
        "answer",
        F.coalesce("_top", F.lit("")).alias("top_sources"),
        F.lit(None).cast("double").alias("quality_score"),
        F.lit("").alias("comments"),
    )


def attach_scores(table: DataFrame, scores: DataFrame, question_id: str = "question_id") -> DataFrame:
    """The table with the readers' ``quality_score`` and ``comments`` put in."""
    return table.drop("quality_score", "comments").join(
        scores.select(question_id, "quality_score", F.coalesce("comments", F.lit("")).alias("comments")),
        question_id,
        "left",
    )


def eval_score(table: DataFrame, score: str = "quality_score") -> DataFrame:
    """Mean score and number of scored rows, those without a score left out."""
    return table.agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_scored"))


def eval_markdown(table: DataFrame, order: str = "question_id") -> DataFrame:
    """The table as Markdown: one line per row with its place ``line_no``, headings first.

    Line ends become blanks and bars are escaped, so that a cell stays in its row.
    """

    def cell(name: str):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))

    def line(*cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    body = table.select(
        F.col(order).cast("long").alias("line_no"), line(*[cell(name) for name in HEADINGS]).alias("value")
    )
    heads = [
        (-2, "| " + " | ".join(HEADINGS.values()) + " |"),
        (-1, "|" + " --- |" * len(HEADINGS)),
    ]
    return table.sparkSession.createDataFrame(heads, "line_no long, value string").unionByName(body)


def write_eval_markdown(table: DataFrame, path: str, order: str = "question_id") -> None:
    """Title and table as text, in the order of the file names; a small table is one file."""
    title = table.sparkSession.createDataFrame(
        [(-4, TITLE), (-3, "")], "line_no long, value string"
    )
    lines = title.unionByName(eval_markdown(table, order))
    lines.orderBy("line_no").select("value").write.mode("overwrite").text(path)
