"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from complaintlens.llm import chat, decontamination, licenses, mixing, near_duplicates, ngram_scores, quality, quality_rules, repeats, toxicity

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, LONG, "en", "b"), (5, "Short text, no more.", "en", "b"),
    (6, "twice the same row of text", "en", "a"), (6, "twice the same row of text", "en", "a"), (6, "the same id with another text", "en", "a"),
    (None, "a text without an id", "en", "a"), (None, "a text without an id", "en", "a"), (7, "Ünïcödé \x1f  tëxt – ok", "de", ""), (8, "\x00", "en", "c"),
]
# Names that the operators use inside.
CLASHING = (
    "id ids th key words word n n_words pos gram hash tpl label exact t copies score spans kept rule k1 k2 data anchor place piece start fp h size h0 "
    "target source_size taken x block part total low component node a b s c0 c1 row turns level formatted held_out predicted windows n_chars"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(0).cast("long").alias(name) for name in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "twice the same row of text"), (1, "twice the same row of text"), (None, "no more"), (2, None), (3, ""), (4, "word1"), (5, "of which nothing is found anywhere at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "repeats": lambda docs, labels, items: repeats.remove_repeats(docs, keep=("lang", "id", "spans")).drop("id", "spans"),
    "toxicity": lambda docs, labels, items: toxicity.score_toxicity(docs, labels),
    "quality": lambda docs, labels, items: quality.score_quality(docs, labels),
    "scores": lambda docs, labels, items: ngram_scores.score_documents(docs),
    "licenses": lambda docs, labels, items: licenses.scan_licenses(docs),
    "near": lambda docs, labels, items: near_duplicates.near_duplicates(docs),
    "mixing": lambda docs, labels, items: mixing.mix_sources(docs, keep=("text", "size", "h")).drop("text", "h"),
    "rules": lambda docs, labels, items: quality_rules.apply_quality_rules(docs),
}


@pytest.mark.parametrize("name", [name for name in OPERATORS if name not in ("repeats", "mixing")] + ["repeats_plain", "mixing_plain"])
def test_a_row_for_each_row(name, docs, labels, items):
    plain = {"repeats_plain": lambda d, *_: repeats.remove_repeats(d), "mixing_plain": lambda d, *_: mixing.mix_sources(d)}
    operator = plain.get(name) or OPERATORS[name]
    found = operator(docs, labels, items)
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r[0]) for r in ROWS)
    assert operator(docs.limit(0), labels, items).count() == 0
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType


def test_no_labels_at_all(docs, labels):
    for operator in (toxicity.score_toxicity, quality.score_quality):
        assert {r.score for r in operator(docs, labels.limit(0)).collect()} == {0.5}


def test_found_items(docs, items):
    found = {(r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontamination.find_items(docs, items).collect()}
    assert found == {(6, 1, 0, 6), (5, None, 2, 2), (4, 4, 2, 1)}
    assert decontamination.find_items(docs.limit(0), items).count() == 0
    assert decontamination.find_items(docs, items.limit(0)).count() == 0


def test_null_and_empty_texts_have_defined_results(docs):
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    removed = by_id(repeats.remove_repeats(docs))
    assert (removed[1].n_bytes, removed[1].kept, removed[4].n_removed > 0) == (0, b"", True)
    prints = by_id(near_duplicates.near_duplicates(docs))
    assert prints[1].fingerprint == prints[2].fingerprint == prints[3].fingerprint == "0" * 16
    assert prints[3].component_id == prints[2].component_id == prints[1].component_id == 1
    mixed = by_id(mixing.mix_sources(docs))
    assert (mixed[1].size, mixed[3].taken, mixed[2].source) == (0, 0, None)
    found = by_id(licenses.scan_licenses(docs))
    assert (found[1].n_words, found[1].labels, found[1].first_word, found[1].score) == (0, "", None, 0.0)
    rules = by_id(quality_rules.apply_quality_rules(docs))
    assert rules[1].base_failed and not rules[1].kept and rules[4].n_words == 60_000


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", ""), (1, 1, None, "x"), (2, None, "assistant", "y" * 300_000), (3, 0, "user", "\\s \\n <|end|>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "i": F.lit(2), "turns": F.lit(3), "level": F.lit(4)})
    turns = chat.read_turns(chat.format_chats(df)).orderBy("conv_id", "i").collect()
    assert [(r.conv_id, r.role, r.text) for r in turns] == [
        (None, "assistant", ""), (1, "user", ""), (1, "", "x"), (1, "", "x"), (2, "assistant", "y" * 300_000), (3, "user", "\\s \\n <|end|>\n"),
    ]
    assert chat.read_turns(chat.format_chats(df.limit(0))).count() == 0


def test_pipeline_stages(spark, docs, labels, items, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        assert {r.doc_id for r in kept.collect()} <= {r[0] for r in ROWS}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if stage is not corpus_pipeline.mix:
            assert kept.columns == corpus_pipeline.COLUMNS


def test_decontamination_of_very_long_items(spark):
    """Items and texts of 40,000 and 70,000 words, repeated and distinct, are found whole; counters do not overflow."""
    from complaintlens.llm import decontamination

    same, distinct = " ".join(["w"] * 70_000), " ".join(f"x{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, same), (2, distinct), (3, "nothing here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(10, same), (11, distinct)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_items(docs, items).collect()}
    assert found == {(1, 10): 1.0, (2, 11): 1.0}


def test_toxicity_learns_from_long_labelled_texts(spark):
    """Labelled texts of 10,000 to 12,500 characters are trained on whole, not left out for their length."""
    import random

    from complaintlens.llm import toxicity

    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    bad = ["hateful", "idiotic", "vile", "scum", "moron"]
    rows, labels = [], []
    for i in range(120):
        toxic = i % 2
        words = []
        while len(" ".join(words)) < rng.randrange(10_000, 12_500):
            words.append(rng.choice(bad) if toxic and rng.random() < 0.08 else rng.choice(plain))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(docs, marks).collect()
    truth = dict((i, t) for i, _, t in labels)
    held = [r for r in found if r.held_out]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert 0 < sum(r.predicted for r in found) < len(found)


def test_toxicity_scores_equal_a_plain_window_by_window_pass():
    """Model.score (batched windows, cached word rows) against one forward pass per window with freshly made inputs."""
    import numpy as np

    from complaintlens.llm import recurrent, toxicity

    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)] + ["vile", "scum"]
    texts = [" ".join(rng.choice(vocab, n)) for n in (0, 1, 5, 63, 64, 65, 200, 500)] + [None, "  "]
    model = toxicity.train([" ".join(rng.choice(vocab, 80)) + (" vile" * (i % 2)) for i in range(40)], np.array([i % 2 for i in range(40)], float), epochs=2)
    got = model.score(texts)
    hidden = toxicity.HIDDEN
    for text, score in zip(texts, got):
        words = toxicity.words_of(text)
        best = -np.inf
        for start in toxicity.window_starts(len(words)):
            part = words[start : start + toxicity.WINDOW]
            x = np.zeros((toxicity.WINDOW, 1, 6 * hidden), np.float32)
            if part:
                x[: len(part), 0] = model.project(model.inputs(part))
            mask = np.zeros((toxicity.WINDOW, 1), np.float32)
            mask[: len(part)] = 1
            logit, _ = recurrent.forward(model.p, x[:, :, : 3 * hidden], x[:, :, 3 * hidden :], mask)
            best = max(best, float(logit[0]))
        assert abs(float(recurrent.sigmoid(np.array(best))) - score) < 1e-5
