import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from complaintlens.functions import display as D
from complaintlens.operators import evaluation, prompts
from complaintlens.options import JobOptions
from complaintlens.plans import answer_queries, jobs

SOURCES = "question_id long, rank int, chunk_text string, product_category string, company string, score double"


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "Why fees?"), (2, "Any fraud?")], "question_id long, question string")


@pytest.fixture
def sources(spark):
    rows = [
        (1, 2, "Second. More", "Credit Card", None, 0.87),
        (1, 1, " Customers report delayed refunds. Often. ", "Credit Card", "Linden Credit Union", 0.91),
        (1, 3, "Third", None, "", 0.5),
    ]
    return spark.createDataFrame(rows, SOURCES)


def by_id(df, column):
    return dict(df.select("question_id", column).collect())


def test_prompt(questions, sources):
    prompt = by_id(prompts.build_prompts(questions, sources, organisation="Some Bank"), "prompt")
    assert prompt[1] == (
        prompts.SYSTEM_CONTEXT.format(organisation="Some Bank")
        + "\n\nCustomer complaint excerpts:\n\n"
        "[Source 1 — Credit Card | Linden Credit Union]\nCustomers report delayed refunds. Often.\n\n"
        "[Source 2 — Credit Card]\nSecond. More\n\n[Source 3]\nThird\n\n"
        "Question: Why fees?\n\nAnswer:"
    )
    assert "Question: Any fraud?" in prompt[2] and "[Source" not in prompt[2]


def test_system_context():
    assert "financial analyst" in prompts.SYSTEM_CONTEXT and len(prompts.SYSTEM_CONTEXT) > 20


def test_document_stands_in_for_text(spark, questions):
    rows = [(1, 1, None, "fallback text field"), (2, 1, "", "other")]
    df = spark.createDataFrame(rows, "question_id long, rank int, chunk_text string, document string")
    prompt = by_id(prompts.build_prompts(questions, df), "prompt")
    assert "[Source 1]\nfallback text field" in prompt[1] and "\nother\n" in prompt[2]


def test_more_than_nine_sources_stay_in_order(spark, questions):
    df = spark.createDataFrame([(1, i, f"text {i}") for i in range(12, 0, -1)], "question_id long, rank int, chunk_text string")
    prompt = by_id(prompts.build_prompts(questions, df), "prompt")[1]
    places = [prompt.index(f"[Source {i}]") for i in range(1, 13)]
    assert places == sorted(places)


def test_extractive_answer(questions, sources):
    answers = by_id(prompts.generate(prompts.build_prompts(questions, sources)), "answer")
    assert answers == {1: "Customers report delayed refunds.", 2: ""}


def test_injected_generator_is_stripped_and_null_is_empty(questions, sources):
    ready = prompts.build_prompts(questions, sources)
    assert by_id(prompts.generate(ready, lambda: lambda p: "  said \n"), "answer") == {1: "said", 2: "said"}
    assert by_id(prompts.generate(ready, lambda: lambda p: None), "answer") == {1: "", 2: ""}


def test_fallback_only_where_the_first_gives_nothing(questions, sources):
    ready = prompts.build_prompts(questions, sources)
    found = prompts.generate_with_fallback(
        ready, lambda: lambda p: "first" if "fees" in p else "", lambda: lambda p: "Fallback answer."
    )
    assert by_id(found, "answer") == {1: "first", 2: "Fallback answer."}


def test_answer_table(spark, questions, sources):
    asked = questions.union(spark.createDataFrame([(3, "  "), (4, None)], questions.schema))
    rows = {r.question_id: r for r in prompts.answer_questions(asked, sources).collect()}
    assert {"answer", "sources", "prompt", "status"} <= set(rows[1].asDict())
    assert [s["rank"] for s in rows[1].sources] == [1, 2, 3]
    assert (rows[3].status, rows[3].answer, rows[4].status) == ("empty", None, "empty")
    assert "enter a question" in rows[3].note


def test_cards(questions, sources):
    cards = {r["rank"]: r for r in prompts.source_cards(sources).collect()}
    assert (cards[1].score_label, cards[1].company, cards[1].color) == ("0.91", "Linden Credit Union", "#00B4D8")
    assert (cards[3].product, cards[3].color, cards[3].icon) == ("Unknown", D.OTHER_COLOR, D.OTHER_ICON)
    for part in (">1. ", "Credit Card", "Linden Credit Union", "0.91", "delayed refunds"):
        assert part in cards[1].html
    shown = by_id(prompts.cards_per_question(questions, sources), "sources_html")
    assert shown[2] == "_No sources retrieved._"
    assert shown[1].count("\n") == 2 and shown[1].index(">1. ") < shown[1].index(">2. ")


def test_card_text_is_cut_and_score_may_be_missing(spark):
    df = spark.createDataFrame([(1, 1, "x" * 500), (1, 2, "y" * 300)], "question_id long, rank int, chunk_text string")
    cards = {r["rank"]: r for r in prompts.source_cards(df).collect()}
    assert cards[1].snippet == "x" * 297 + "..." and cards[2].snippet == "y" * 300
    assert cards[1].score_label == "" and "relevance" not in cards[1].html


def test_score_label_rounds_as_python_does(spark):
    rng = random.Random(1)
    values = [0.125, 0.375, 0.625, 0.165, 0.145, 0.005, 0.015, 1.005, 2.675, 0.0, -0.0, 1.0, 0.995, 12345.675]
    values += [rng.random() for _ in range(2000)] + [rng.randrange(4000) / 1000 for _ in range(2000)]
    values += [rng.randrange(8000) / 8 for _ in range(200)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    labels = [r[0] for r in df.select(D.score_label(F.col("x"))).collect()]
    assert labels == [f"{v:.2f}" for v in values]
    assert spark.createDataFrame([(None,)], "x double").select(D.score_label(F.col("x"))).first()[0] == ""


def test_bold(spark):
    texts = ["a **b** c **d e**", "**x\ny**", "none", "****"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.markdown_bold(F.col("t"))).collect()] == [
        "a <strong>b</strong> c <strong>d e</strong>", "**x\ny**", "none", "****",
    ]


def test_evaluation(spark, questions, sources, tmp_path):
    answers = prompts.generate(prompts.build_prompts(questions, sources))
    table = evaluation.eval_table(answers, sources)
    rows = {r.question_id: r for r in table.collect()}
    assert rows[1].top_sources == "[Credit Card] Customers report delayed refunds. Often. | [Credit Card] Second. More"
    assert (rows[2].top_sources, rows[1].quality_score, rows[1].comments) == ("", None, "")
    scores = spark.createDataFrame([(1, 4.0, "fine | good")], "question_id long, quality_score double, comments string")
    scored = evaluation.attach_scores(table, scores)
    assert evaluation.eval_score(scored).first() == (4.0, 1)
    path = str(tmp_path / "table")
    evaluation.write_eval_markdown(scored, path)
    files = [f for f in (tmp_path / "table").iterdir() if f.name.startswith("part-")]
    assert len(files) == 1
    lines = files[0].read_text().splitlines()
    assert lines[0] == evaluation.TITLE and lines[1] == ""
    assert lines[2].startswith("| Question | Generated Answer |") and len(lines) == 6
    assert lines[4].endswith("| 4.0 | fine \\| good |")


def test_whole_way_from_complaints_to_answers(spark):
    rows = [
        (i, "Credit card" if i % 2 else "Money transfer", f"the bank lost my {'card' if i % 2 else 'transfer'} number {i}. " * 3)
        for i in range(40)
    ]
    raw = spark.createDataFrame(rows, "complaint_id long, product string, narrative string")
    options = JobOptions(top_k=3, chunk_size=60, chunk_overlap=10, vector_width=64, sample_size=40)
    cleaned = jobs.clean_complaints(raw)
    assert cleaned.columns == ["complaint_id", "product_category", "product", "narrative", "clean_narrative", "clean_word_count"]
    index = jobs.chunks_with_vectors(cleaned, options)
    asked = spark.createDataFrame([(1, "lost card number 7"), (2, " ")], "question_id long, question string")
    told = {r.question_id: r for r in jobs.answer(index, asked, options).collect()}
    assert len(told[1].sources) == 3 and told[1].answer
    assert told[1].sources[0].complaint_id == 7 and told[2].status == "empty"


def test_questions_reach_the_embedder_as_asked(spark):
    class ByScript:
        def embed(self, texts):
            return np.array([[1.0, 0.0] if t == "Жалоба: FEES?" else [0.0, 1.0] for t in texts])

    asked = spark.createDataFrame([(1, "Жалоба: FEES?")], "question_id long, question string")
    assert jobs.embed_questions(asked, factory=ByScript, width=2).first().question_vec == [1.0, 0.0]
    assert jobs.embed_questions(asked, factory=ByScript, width=2, clean=True).first().question_vec == [0.0, 1.0]


def test_options_and_organisation_reach_the_generator(spark):
    index = spark.createDataFrame([("a", "a fee", [1.0, 0.0])], "chunk_id string, chunk_text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "fees?"), (2, " ")], "question_id long, question string")

    class One:
        def embed(self, texts):
            return np.array([[1.0, 0.0]] * len(texts))

    def generator(options):
        return lambda prompt: f"{options.max_answer_tokens} {options.temperature} {'Linden' in prompt}"

    told = jobs.answer(index, asked, JobOptions(vector_width=2, max_answer_tokens=99, temperature=0.1), One, generator, organisation="Linden")
    rows = {r.question_id: r for r in told.collect()}
    assert rows[1].answer == "99 0.1 True" and rows[2].answer is None and rows[1].sources[0].chunk_id == "a"


def test_chunks_are_cut_and_embedded_in_stages_of_their_own(spark, tmp_path, monkeypatch):
    text = "The bank charged a fee twice and nobody answered my letters about it. " * 12
    rows = [(i, f"Case {i}. {text}", "en", "bank") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "Who charged a fee?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plans, embed = [], answer_queries.embedding.embed

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return embed(df, *args)

    monkeypatch.setattr(answer_queries.embedding, "embed", watched)
    found = {r.question_id: r for r in answer_queries.chunk_answers(spark, str(tmp_path)).collect()}
    assert found[1].status == "ok" and len(found[1].chunk_ids.split(",")) == 3 and found[-2].status == "empty"
    assert plans and not any("ArrowEvalPython" in plan for plan in plans)
