"""Registered queries from question texts to prompts, answers, cards and the evaluation table.

The questions are all items of the ``benchmark`` table; the searched texts are all cleaned
complaints, with the vectors of the hashed embedder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.functions import display as D
from complaintlens.operators import chunking, embedding, evaluation, prompts
from complaintlens.operators.prepare import filter_with_text
from complaintlens.options import JobOptions
from complaintlens.plans import inputs as I
from complaintlens.plans import jobs
from complaintlens.plans.registry import query
from complaintlens.session import scratch_dir, written_once

WIDTH = 128
TOP_K = 3
OPTIONS = JobOptions(top_k=TOP_K, vector_width=WIDTH)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark items as questions, and for each a blank one with an id below zero."""
    items = I.table(spark, folder, "benchmark")
    blank = items.select((-1 - F.col("item_id")).alias("question_id"), F.lit("  ").alias("question"))
    return items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).union(blank)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and metadata of all cleaned complaints, written once and read back."""
    rows = I.cleaned(spark, folder).select(
        F.col("complaint_id").alias("chunk_id"),
        F.col("clean_narrative").alias("chunk_text"),
        "product_category",
        "company",
    )
    path = scratch_dir(spark, "answer-index")
    embedding.embed(rows, "chunk_text", embedding.hashed(WIDTH)).write.parquet(path)
    return spark.read.parquet(path)


def sources(spark: SparkSession, folder: str) -> DataFrame:
    asked = filter_with_text(questions(spark, folder), "question")
    vectors = jobs.embed_questions(asked, width=WIDTH, clean=True)
    return jobs.find_sources(index(spark, folder), vectors, OPTIONS)


def _vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name``(id, b, x): non-zero components of the hashed vectors, as stored in single precision."""
    return f"""{name}_n AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {WIDTH} AS b, count(*) AS n
  FROM (SELECT {key} AS id, unnest(string_split({text}, ' ')) AS t FROM {source}) WHERE t <> '' GROUP BY ALL),
{name}_l AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS length FROM {name}_n GROUP BY id),
{name} AS (SELECT id, b, (n / length)::FLOAT::DOUBLE AS x FROM {name}_n JOIN {name}_l USING (id)),
{name}_norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {name} GROUP BY id)"""


def _found_sql(pieces: str) -> str:
    """CTEs ending in ``src``: the best rows of ``piece``(chunk_id, chunk_text, ...) per question."""
    return f"""{I.WITH_CLEAN}, {pieces},
asked AS (SELECT item_id AS question_id, text AS question FROM benchmark
  UNION ALL SELECT -1 - item_id, '  ' FROM benchmark),
ok AS (SELECT *, {I.sql_clean('question')} AS cleaned FROM asked WHERE {I.sql_has_text('question')}),
{_vectors_sql('qv', 'ok', 'question_id', 'cleaned')},
{_vectors_sql('cv', 'piece', 'chunk_id', 'chunk_text')},
dots AS (SELECT qv.id AS question_id, cv.id AS chunk_id, sum(qv.x * cv.x) AS d FROM qv JOIN cv USING (b) GROUP BY ALL),
scored AS (SELECT question_id, chunk_id, round(d / (a.norm * b.norm), 12) AS score FROM dots
  JOIN qv_norm a ON a.id = question_id JOIN cv_norm b ON b.id = chunk_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM scored),
src AS (SELECT question_id, chunk_id, score, rank, chunk_text, product_category, company
  FROM ranked JOIN piece USING (chunk_id) WHERE rank <= {TOP_K})"""


_FOUND = _found_sql(
    "piece AS (SELECT complaint_id AS chunk_id, clean_narrative AS chunk_text, product_category, company FROM clean)"
)
_CHUNK_FOUND = I.recursive(
    _found_sql(
        f"""base AS (SELECT complaint_id AS id, clean_narrative AS text FROM clean),
{I.sql_chunks('base', OPTIONS.chunk_size, OPTIONS.chunk_overlap)},
piece AS (SELECT concat(id, '_', chunk_index) AS chunk_id, chunk_text, product_category, company
  FROM chunks JOIN clean ON complaint_id = id)"""
    )
)

_HEADER = """concat('[Source ', rank, CASE WHEN concat_ws(' | ', nullif(product_category, ''), nullif(company, '')) <> ''
  THEN concat(' — ', concat_ws(' | ', nullif(product_category, ''), nullif(company, ''))) ELSE '' END, ']')"""
_OPENING = prompts.SYSTEM_CONTEXT.format(organisation=prompts.DEFAULT_ORGANISATION)


def _prompts_sql(asked: str, source: str, text: str) -> str:
    return f"""blocks AS (SELECT question_id, string_agg(concat({_HEADER}, chr(10), {text}), chr(10) || chr(10) ORDER BY rank) AS context
  FROM {source} GROUP BY question_id),
prompts AS (SELECT a.question_id, question, concat({I.sql_text(_OPENING)}, chr(10), chr(10), 'Customer complaint excerpts:', chr(10), chr(10),
  coalesce(context, ''), chr(10), chr(10), 'Question: ', question, chr(10), chr(10), 'Answer:') AS prompt
  FROM {asked} a LEFT JOIN blocks USING (question_id))"""


_PROMPTS = f"{_FOUND}, {_prompts_sql('ok', 'src', 'trim(chunk_text)')}"
# First sentence of the first source.
_FIRST = r"""trim(regexp_extract(regexp_extract(prompt, '\[Source 1[^\n]*\n((?s:.*?))(?:\n\n\[Source 2|\n\nQuestion: )', 1), '^[^.]*\.?'))"""


@query(
    "question_status",
    f"""SELECT item_id AS question_id, text AS question, 'ok' AS status, CAST(NULL AS VARCHAR) AS note FROM benchmark
UNION ALL SELECT -1 - item_id, '  ', 'empty', {I.sql_text(prompts.EMPTY_QUESTION_NOTE)} FROM benchmark""",
)
def question_status(spark, folder):
    return prompts.question_status(questions(spark, folder))


@query(
    "question_sources",
    f"{_FOUND} SELECT question_id, chunk_id, round(score, 6) AS score, rank, product_category, company FROM src",
)
def question_sources(spark, folder):
    found = sources(spark, folder).select(
        "question_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "product_category", "company"
    )
    return found


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Every complaint as the one source of a question, with a score derived from its id."""
    cc = I.mapped(spark, folder)
    return cc.select(
        F.col("complaint_id").alias("question_id"),
        "product_category",
        "company",
        F.nullif("narrative", F.lit("   ")).alias("chunk_text"),
        F.when(F.col("complaint_id") % 2 == 0, F.col("issue")).alias("document"),
        F.lit(1).alias("rank"),
        F.when(F.col("complaint_id") % 3 > 0, F.col("complaint_id") / F.lit(7.0)).alias("score"),
    )


_LISTED = f"""{I.WITH_CC}, listed AS (SELECT complaint_id AS question_id, product_category, company,
  nullif(narrative, '   ') AS chunk_text, CASE WHEN complaint_id % 2 = 0 THEN issue END AS document, 1 AS rank,
  CASE WHEN complaint_id % 3 > 0 THEN complaint_id / 7.0::DOUBLE END AS score FROM mapped),
texts AS (SELECT *, {I.sql_strip("coalesce(nullif(chunk_text, ''), document, '')")} AS body FROM listed),
asked AS (SELECT doc_id AS question_id, source AS question FROM documents)"""


@query("build_prompt", f"{_LISTED}, {_prompts_sql('asked', 'texts', 'body')} SELECT * FROM prompts")
def build_prompt(spark, folder):
    """A prompt per document: its own complaint as the source, with missing text, product or both."""
    asked = I.table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("source").alias("question")
    )
    return prompts.build_prompts(asked, listed(spark, folder))


def _map_sql(values: dict[str, str], other: str) -> str:
    cases = " ".join(f"WHEN {I.sql_text(k)} THEN {I.sql_text(v)}" for k, v in values.items())
    return f"CASE product_category {cases} ELSE {I.sql_text(other)} END"


_CARDS = f"""{_LISTED}, cards AS (SELECT question_id, rank AS source_number,
  coalesce(product_category, 'Unknown') AS product, coalesce(company, '') AS company,
  CASE WHEN length(body) > 300 THEN concat(substring(body, 1, 297), '...') ELSE body END AS snippet,
  CASE WHEN score IS NULL THEN '' ELSE printf('%.2f', score) END AS score_label,
  {_map_sql(D.PRODUCT_COLORS, D.OTHER_COLOR)} AS color, {_map_sql(D.PRODUCT_ICONS, D.OTHER_ICON)} AS icon FROM texts)"""
_CARD_HTML = """concat('<article><h4 style="color:', color, '">', source_number, '. ', icon, ' ', product, '</h4><p>',
  CASE WHEN company = '' THEN '' ELSE concat('<b>', company, '</b> ') END,
  CASE WHEN score_label = '' THEN '' ELSE concat('<i>score ', score_label, '</i>') END, '</p><blockquote>', snippet, '</blockquote></article>')"""


@query("source_cards", f"{_CARDS} SELECT *, {_CARD_HTML} AS html FROM cards")
def source_cards(spark, folder):
    return prompts.source_cards(listed(spark, folder)).select(
        "question_id", "source_number", "product", "company", "snippet", "score_label", "color", "icon", "html"
    )


@query(
    "question_cards",
    f"""{_CARDS}, html AS (SELECT question_id, {_CARD_HTML} AS html FROM cards),
both_ids AS (SELECT question_id FROM asked UNION ALL SELECT -1 - question_id FROM asked)
SELECT question_id, coalesce(html, {I.sql_text(D.NO_SOURCES)}) AS sources_html FROM both_ids LEFT JOIN html USING (question_id)""",
)
def question_cards(spark, folder):
    """The cards of each document's own complaint, and for each document a question without sources."""
    ids = I.table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"))
    asked = ids.union(ids.select(-1 - F.col("question_id")))
    return prompts.cards_per_question(asked, listed(spark, folder))


@query("rag_prompts", f"{_PROMPTS} SELECT question_id, prompt FROM prompts")
def rag_prompts(spark, folder):
    asked = filter_with_text(questions(spark, folder), "question")
    return prompts.build_prompts(asked, sources(spark, folder)).select("question_id", "prompt")


@query(
    "rag_answers",
    f"""{_PROMPTS} SELECT question_id, question, 'ok' AS status, {_FIRST} AS answer,
  (SELECT count(*) FROM src WHERE src.question_id = prompts.question_id) AS n_sources FROM prompts
UNION ALL SELECT question_id, question, 'empty', NULL, 0 FROM asked WHERE NOT {I.sql_has_text('question')}""",
)
def rag_answers(spark, folder):
    told = jobs.answer(index(spark, folder), questions(spark, folder), OPTIONS, clean_questions=True)
    return told.select(
        "question_id",
        "question",
        "status",
        "answer",
        F.coalesce(F.array_size("sources"), F.lit(0)).cast("long").alias("n_sources"),
    )


def failing_once(options: JobOptions) -> prompts.Generate:
    """The extractive generator, but one that fails for about every third prompt (by its hash), as a model service may."""
    import zlib

    plain = prompts.extractive()

    def answer(text: str) -> str:
        if zlib.crc32(text.encode()) % 3 == 0:
            raise TimeoutError("the model did not answer")
        return plain(text)

    return answer


@query(
    "rag_answers_resumed",
    f"""{_PROMPTS} SELECT question_id, question, 'ok' AS status, {_FIRST} AS answer,
  (SELECT count(*) FROM src WHERE src.question_id = prompts.question_id) AS n_sources FROM prompts
UNION ALL SELECT question_id, question, 'empty', NULL, 0 FROM asked WHERE NOT {I.sql_has_text('question')}""",
)
def rag_answers_resumed(spark, folder):
    """rag_answers through an answer log: a first run whose model fails for some prompts, a second that asks only those."""
    log = scratch_dir(spark, "answer-log")
    stored, asked = index(spark, folder), questions(spark, folder)
    jobs.answer(stored, asked, OPTIONS, generator=failing_once, clean_questions=True, log_path=log)
    told = jobs.answer(stored, asked, OPTIONS, clean_questions=True, log_path=log)
    return told.select(
        "question_id",
        "question",
        "status",
        "answer",
        F.coalesce(F.array_size("sources"), F.lit(0)).cast("long").alias("n_sources"),
    )


@query(
    "numbered_sources",
    f"{_FOUND} SELECT question_id, rank AS source_number, chunk_id, product_category, company FROM src",
)
def numbered_sources(spark, folder):
    told = jobs.answer(index(spark, folder), questions(spark, folder), OPTIONS, clean_questions=True)
    return prompts.numbered_sources(told).select(
        "question_id", "source_number", "chunk_id", "product_category", "company"
    )


def _only_long() -> prompts.Generate:
    """A generator that stays silent on short first sentences."""
    return lambda prompt: text if len(text := prompts.first_sentence(prompt)) > 60 else ""


def _say_unknown() -> prompts.Generate:
    return lambda prompt: "The excerpts do not say."


@query(
    "answer_fallback",
    rf"""{_PROMPTS}, said AS (SELECT question_id, {_FIRST} AS answer FROM prompts)
SELECT question_id, CASE WHEN length(answer) > 60 THEN answer ELSE 'The excerpts do not say.' END AS answer FROM said""",
)
def answer_fallback(spark, folder):
    asked = filter_with_text(questions(spark, folder), "question")
    ready = prompts.build_prompts(asked, sources(spark, folder))
    return prompts.generate_with_fallback(ready, _only_long, _say_unknown).select("question_id", "answer")


_EVAL = f"""{_PROMPTS}, lines AS (SELECT question_id, rank, replace(chunk_text, chr(10), ' ') AS line, product_category FROM src WHERE rank <= 2),
tops AS (SELECT question_id, string_agg(concat('[', product_category, '] ', CASE WHEN length(trim(line)) > 120
  THEN concat(rtrim(substring(trim(line), 1, 120)), '...') ELSE trim(line) END), ' | ' ORDER BY rank) AS top_sources FROM lines GROUP BY question_id),
eval AS (SELECT question_id, question, {_FIRST} AS answer, coalesce(top_sources, '') AS top_sources,
  CAST(NULL AS DOUBLE) AS quality_score, '' AS comments FROM prompts LEFT JOIN tops USING (question_id))"""


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    asked = filter_with_text(questions(spark, folder), "question")
    found = sources(spark, folder)
    answers = prompts.generate(prompts.build_prompts(asked, found))
    return evaluation.eval_table(answers, found)


@query("eval_table", f"{_EVAL} SELECT * FROM eval")
def eval_table(spark, folder):
    return evaluated(spark, folder)


def _cell_sql(column: str) -> str:
    text = f"coalesce(CAST({column} AS VARCHAR), '')"
    return rf"replace(regexp_replace({text}, '\s*\n\s*', ' ', 'g'), '|', '\|')"


@query(
    "eval_markdown",
    f"""{_EVAL}
SELECT concat('| ', concat_ws(' | ', {', '.join(_cell_sql(c) for c in evaluation.HEADINGS)}), ' |') AS value FROM eval
UNION ALL SELECT * FROM (VALUES ({I.sql_text(evaluation.TITLE)}), (''),
  ({I.sql_text('| ' + ' | '.join(evaluation.HEADINGS.values()) + ' |')}), ('|{' --- |' * len(evaluation.HEADINGS)}')) t(value)""",
)
def eval_markdown(spark, folder):
    path = scratch_dir(spark, "evaluation")
    evaluation.write_eval_markdown(evaluated(spark, folder), path)
    return spark.read.text(path)


@query(
    "eval_score",
    f"""{_EVAL}, marks AS (SELECT quality * 4 + 1 AS s FROM eval JOIN labels ON doc_id = question_id)
SELECT round(avg(s), 6) AS mean_score, count(s) AS n_scored FROM marks""",
)
def eval_score(spark, folder):
    """Labels of the documents with the ids of the questions stand in for the readers' scores."""
    scores = I.table(spark, folder, "labels").select(
        F.col("doc_id").alias("question_id"),
        (F.col("quality") * 4 + 1).cast("double").alias("quality_score"),
        F.lit(None).cast("string").alias("comments"),
    )
    table = evaluation.attach_scores(evaluated(spark, folder), scores)
    return evaluation.eval_score(table).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "chunk_answers",
    f"""{_CHUNK_FOUND}, {_prompts_sql('ok', 'src', 'trim(chunk_text)')}
SELECT question_id, 'ok' AS status, {_FIRST} AS answer,
  (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM src WHERE src.question_id = prompts.question_id) AS chunk_ids
FROM prompts UNION ALL SELECT question_id, 'empty', NULL, NULL FROM asked WHERE NOT {I.sql_has_text('question')}""",
)
def chunk_answers(spark, folder):
    """Answers over the chunks of all cleaned complaints, from raw rows to sources."""
    chunks = chunking.chunk_documents(
        I.cleaned(spark, folder), "clean_narrative", "complaint_id", ["product_category", "company"]
    )
    # Cut in one stage and embedded in the next, so that a task has one Python worker at a time and not both.
    chunks = written_once(chunks, "chunks")
    path = scratch_dir(spark, "chunk-index")
    embedding.embed(chunks, "chunk_text", embedding.hashed(WIDTH)).write.parquet(path)
    told = jobs.answer(spark.read.parquet(path), questions(spark, folder), OPTIONS, clean_questions=True)
    return told.select(
        "question_id", "status", "answer", F.array_join("sources.chunk_id", ",").alias("chunk_ids")
    )
