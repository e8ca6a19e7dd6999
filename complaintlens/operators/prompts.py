"""Prompts, answers and source cards for a table of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintlens.functions import display as D
from complaintlens.functions.text import has_text

# The wording of the prompt. ``{organisation}`` is filled in by the caller.
SYSTEM_CONTEXT = (
    "You are a financial analyst assistant at {organisation}. "
    "Your job is to answer questions about customer complaints based solely "
    "on the complaint excerpts provided. Be concise, structured, and factual. "
    "If the provided excerpts do not contain enough information to answer the "
    "question, say so explicitly rather than speculating."
)
EXCERPTS_LINE = "Customer complaint excerpts:"
DEFAULT_ORGANISATION = "a financial company"
PROMPTS_PER_TASK = 16
EMPTY_QUESTION_NOTE = "Please enter a question above, or click one of the examples."

Generate = Callable[[str], "str | None"]
GeneratorFactory = Callable[[], Generate]


def _column(df: DataFrame, name: str) -> Column:
    """The column, or nulls where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def question_status(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds ``status``: ``ok``, or ``empty`` for blank questions, with a note asking for input."""
    filled = has_text(F.col(question))
    return questions.withColumn(
        "status", F.when(filled, F.lit("ok")).otherwise(F.lit("empty"))
    ).withColumn("note", F.when(~filled, F.lit(EMPTY_QUESTION_NOTE)))


def source_blocks(sources: DataFrame) -> DataFrame:
    """Adds ``block``: header and text of one retrieved source, as it stands in the prompt."""
    header = D.source_header(
        F.col("rank"), _column(sources, "product_category"), _column(sources, "company")
    )
    text = D.text_or_document(_column(sources, "chunk_text"), _column(sources, "document"))
    return sources.withColumn("block", F.concat(header, F.lit("\n"), text))


def build_prompts(
    questions: DataFrame,
    sources: DataFrame,
    question_id: str = "question_id",
    question: str = "question",
    organisation: str = DEFAULT_ORGANISATION,
    system_context: str = SYSTEM_CONTEXT,
) -> DataFrame:
    """Adds ``prompt`` to each question; a question without sources has one too.

    A group holds the retrieved sources of one question, so at most k rows.
    """
    told = with_sources(questions, sources, question_id)
    return told.withColumn("prompt", prompt_text("_blocks", question, organisation, system_context)).drop("_blocks", "sources")


def prompt_text(blocks: str, question: str, organisation: str, system_context: str = SYSTEM_CONTEXT) -> Column:
    """The prompt of a question from the array of its source blocks (null without sources)."""
    opening = system_context.format(organisation=organisation)
    return F.concat(
        F.lit(f"{opening}\n\n{EXCERPTS_LINE}\n\n"),
        F.coalesce(F.array_join(blocks, "\n\n"), F.lit("")),
        F.lit("\n\nQuestion: "),
        F.coalesce(F.col(question), F.lit("")),
        F.lit("\n\nAnswer:"),
    )


def with_sources(questions: DataFrame, sources: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Adds ``sources``, the retrieved rows of a question as an array by rank, and ``_blocks``, their texts for a prompt.

    One grouping and one join; a group holds the retrieved sources of one question, so at most k rows.
    """
    rest = [F.col(f"`{c}`") for c in sources.columns if c not in (question_id, "rank")]
    row = F.struct("rank", F.struct("rank", *rest).alias("source"), "block")
    grouped = source_blocks(sources).groupBy(question_id).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    grouped = grouped.select(question_id, F.col("_rows.source").alias("sources"), F.col("_rows.block").alias("_blocks"))
    return questions.join(grouped, question_id, "left")


def first_sentence(prompt: str) -> str:
    """First sentence of the first source of a prompt; empty without sources."""
    start = prompt.find("\n", prompt.find("[Source 1"))
    if "[Source 1" not in prompt or start < 0:
        return ""
    text = prompt[start + 1 :]
    for stop in ("\n\n[Source 2", "\n\nQuestion: "):
        text = text.split(stop, 1)[0]
    end = text.find(".")
    return text[: end + 1] if end >= 0 else text


def extractive() -> Generate:
    """Factory of the generator used where no language model is at hand."""
    return first_sentence


def generate(
    df: DataFrame, factory: GeneratorFactory = extractive, prompt: str = "prompt", output: str = "answer"
) -> DataFrame:
    """Adds the generated text, stripped, empty if the generator gives none.

    A model may answer differently each time, so the plan must not ask it twice.
    """

    @F.pandas_udf("string")
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = factory()
        for prompts in parts:
            yield prompts.map(lambda text: (answer(text) or "").strip())

    return df.withColumn(output, answers.asNondeterministic()(F.col(prompt)))


def _with_fallback(primary: GeneratorFactory, fallback: GeneratorFactory) -> GeneratorFactory:
    def both() -> Generate:
        first, second = primary(), fallback()
        return lambda text: (first(text) or "") or second(text)

    return both


def generate_with_fallback(
    df: DataFrame,
    primary: GeneratorFactory,
    fallback: GeneratorFactory,
    prompt: str = "prompt",
    output: str = "answer",
) -> DataFrame:
    """As ``generate``; where the first generator gives nothing, the second one is asked."""

    def both() -> Generate:
        first, second = primary(), fallback()
        return lambda text: (first(text) or "") or second(text)

    return generate(df, both, prompt, output)


def _stored_log(df: DataFrame, log_path: str) -> DataFrame | None:
    """The answer log at ``log_path``, or None before the first run wrote it."""
    from pyspark.errors import AnalysisException

    try:
        return df.sparkSession.read.parquet(log_path)
    except AnalysisException:
        return None


def generate_logged(
    df: DataFrame, factory: GeneratorFactory, log_path: str, question_id: str = "question_id", prompt: str = "prompt", output: str = "answer"
) -> DataFrame:
    """As ``generate``, but answers go to a log that later runs go on from; adds ``output`` and ``attempts``.

    The log at ``log_path`` (a shared folder) has a row per question asked and attempt: ``question_id``, attempt, answer,
    error. Only questions without an answer in the log are asked, each once a run; a generator that fails for a prompt
    leaves an error there, and the question open for the next run instead of failing the job. The log is appended by one
    write per run, so a job that fails adds nothing. ``output`` is null for questions still open.
    """
    log = _stored_log(df, log_path)
    open_ = df
    if log is not None:
        done = log.filter(F.col("error").isNull()).select(question_id).distinct()
        tries = log.groupBy(question_id).agg(F.max("attempt").alias("_tries"))
        open_ = df.join(done, question_id, "left_anti").join(tries, question_id, "left")
    else:
        open_ = df.withColumn("_tries", F.lit(None).cast("int"))

    @F.pandas_udf("answer string, error string")
    def asked(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        answer = factory()

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return (answer(text) or "").strip(), None
            except Exception as failure:  # noqa: BLE001 - any failure of a model call leaves the question open
                return None, f"{type(failure).__name__}: {failure}"[:1000]

        for prompts in parts:
            found = [one(text) for text in prompts]
            yield pd.DataFrame({"answer": [a for a, _ in found], "error": [e for _, e in found]})

    result = asked.asNondeterministic()(F.col(prompt))
    fresh = open_.select(question_id, (F.coalesce(F.col("_tries"), F.lit(0)) + 1).cast("int").alias("attempt"), result.alias("_r"))
    fresh.select(question_id, "attempt", "_r.answer", "_r.error").write.mode("append").parquet(log_path)
    log = df.sparkSession.read.parquet(log_path)
    answered = log.groupBy(question_id).agg(
        F.max(F.when(F.col("error").isNull(), F.col("answer"))).alias(output), F.count(F.lit(1)).cast("int").alias("attempts")
    )
    return df.join(answered, question_id, "left")


def answer_questions(
    questions: DataFrame,
    sources: DataFrame,
    factory: GeneratorFactory = extractive,
    fallback: GeneratorFactory | None = None,
    question_id: str = "question_id",
    question: str = "question",
    organisation: str = DEFAULT_ORGANISATION,
    log_path: str | None = None,
) -> DataFrame:
    """Answer, sources and prompt of each question. Blank questions get status ``empty`` and no answer.

    With ``log_path`` answers are logged and a run asks only what earlier runs left open (``generate_logged``).
    """
    marked = question_status(questions, question)
    asked = marked.filter(F.col("status") == "ok")
    prompts = with_sources(asked, sources, question_id)
    prompts = prompts.withColumn("prompt", prompt_text("_blocks", question, organisation)).drop("_blocks")
    # Prompts are small but slow to answer, so their number rather than their bytes decides on the tasks.
    tasks = max(1, -(-asked.count() // PROMPTS_PER_TASK))
    prompts = prompts.repartition(tasks, question_id)
    if log_path is not None:
        both = factory if fallback is None else _with_fallback(factory, fallback)
        answered = generate_logged(prompts, both, log_path, question_id)
    elif fallback is None:
        answered = generate(prompts, factory)
    else:
        answered = generate_with_fallback(prompts, factory, fallback)
    return answered.unionByName(marked.filter(F.col("status") == "empty"), allowMissingColumns=True)


def numbered_sources(answers: DataFrame, question_id: str = "question_id") -> DataFrame:
    """The ``sources`` arrays of answers as rows again, numbered from 1 in ``source_number``."""
    rows = answers.select(question_id, F.posexplode("sources").alias("_place", "_source"))
    return rows.select(question_id, (F.col("_place") + 1).alias("source_number"), "_source.*")


def source_cards(sources: DataFrame) -> DataFrame:
    """One card per retrieved source: number, product, company, snippet, label, colour, icon, HTML."""
    text = D.text_or_document(_column(sources, "chunk_text"), _column(sources, "document"))
    score = F.col("score") if "score" in sources.columns else F.lit(None).cast("double")
    cards = (
        sources.withColumn("source_number", F.col("rank"))
        .withColumn("product", F.coalesce(_column(sources, "product_category"), F.lit(D.UNKNOWN_PRODUCT)))
        .withColumn("company", F.coalesce(_column(sources, "company"), F.lit("")))
        .withColumn("snippet", D.snippet(text))
        .withColumn("score_label", D.score_label(score))
        .withColumn("color", D.product_color(F.col("product")))
        .withColumn("icon", D.product_icon(F.col("product")))
    )
    return cards.withColumn(
        "html",
        D.source_card_html(
            F.col("source_number"), F.col("product"), F.col("company"), F.col("snippet"), score
        ),
    )


def cards_per_question(
    questions: DataFrame, sources: DataFrame, question_id: str = "question_id"
) -> DataFrame:
    """The cards of each question in one text, by rank; a fixed note where nothing was found."""
    joined = (
        source_cards(sources)
        .groupBy(question_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "html"))).alias("_cards"))
        .select(question_id, F.array_join(F.col("_cards.html"), "\n").alias("_html"))
    )
    return questions.join(joined, question_id, "left").select(
        *questions.columns, F.coalesce("_html", F.lit(D.NO_SOURCES)).alias("sources_html")
    )


def rendered_answer(answer: Column) -> Column:
    """The answer as HTML, bold text marked up."""
    return F.concat(F.lit('<div class="answer-text">'), D.markdown_bold(answer), F.lit("</div>"))
