"""The jobs a user runs: complaints to cleaned table, to chunk vectors, to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.functions.text import clean_narrative
from complaintlens.operators.chunking import chunk_documents
from complaintlens.operators.embedding import EmbedderFactory, embed, hashed
from complaintlens.operators.prepare import filter_with_text, prepare_complaints
from complaintlens.operators.prompts import DEFAULT_ORGANISATION, Generate, answer_questions, extractive
from complaintlens.operators.retrieval import attach_metadata, retrieve
from complaintlens.operators.sampling import stratified_sample
from complaintlens.options import JobOptions
from complaintlens.session import written_once
from complaintlens.sources.columns import (
    chunk_metadata_columns,
    id_column_fallback,
    select_existing,
    text_column_fallback,
)
from complaintlens.sources.complaints import CLEAN_COLUMNS

ROWS_PER_TASK = 500


def clean_complaints(raw: DataFrame) -> DataFrame:
    """Raw complaints to the cleaned table, in one narrow stage."""
    return select_existing(prepare_complaints(raw), CLEAN_COLUMNS)


def chunks_with_vectors(
    cleaned: DataFrame, options: JobOptions = JobOptions(), factory: EmbedderFactory | None = None
) -> DataFrame:
    """Cleaned table to a stratified sample, its chunks and their vectors."""
    key = id_column_fallback(cleaned)
    sample = stratified_sample(cleaned, "product_category", options.sample_size, key, options.seed)
    # A sample has few bytes, but embedding is slow per row.
    sample = sample.repartition(max(1, -(-options.sample_size // ROWS_PER_TASK)), key)
    chunks = chunk_documents(
        sample,
        text_column_fallback(sample),
        key,
        chunk_metadata_columns(sample),
        options.chunk_size,
        options.chunk_overlap,
    )
    return embed(chunks, "chunk_text", factory or hashed(options.vector_width))


def embed_questions(
    questions: DataFrame, question: str = "question", factory: EmbedderFactory | None = None,
    width: int = JobOptions.vector_width, clean: bool = False,
) -> DataFrame:
    """Adds ``question_vec``, of the question as asked or, with ``clean``, cleaned as the narratives are."""
    text = clean_narrative(F.col(question)) if clean else F.col(question)
    vectors = embed(questions.withColumn("_text", text), "_text", factory or hashed(width), "question_vec")
    return vectors.drop("_text")


def find_sources(
    index: DataFrame, questions: DataFrame, options: JobOptions = JobOptions(), key: str = "chunk_id"
) -> DataFrame:
    """The best rows of the index per question, with their metadata, as a small stored table."""
    hits = retrieve(index, questions, options.top_k, options.vector_width, key)
    return written_once(attach_metadata(hits, index.drop("embedding"), key), "sources")


def answer(
    index: DataFrame,
    questions: DataFrame,
    options: JobOptions = JobOptions(),
    embedder: EmbedderFactory | None = None,
    generator: Callable[[JobOptions], Generate] = lambda options: extractive(),
    fallback: Callable[[JobOptions], Generate] | None = None,
    clean_questions: bool = False,
    organisation: str = DEFAULT_ORGANISATION,
    log_path: str | None = None,
) -> DataFrame:
    """Questions (question_id, question) to answers with sources and prompts.

    With ``log_path`` answers are logged there, and a rerun asks only questions still without an answer.

    Generators are made in the tasks from the options, which hold the temperature and the length of answers.
    ``clean_questions`` is for an embedder that knows cleaned text only, as the hashed one does.
    """
    asked = filter_with_text(questions, "question")
    vectors = embed_questions(asked, "question", embedder, options.vector_width, clean_questions)
    sources = find_sources(index, vectors, options)
    other = None if fallback is None else lambda: fallback(options)
    return answer_questions(questions, sources, lambda: generator(options), other, organisation=organisation, log_path=log_path)
