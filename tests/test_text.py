import re
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from complaintlens.functions import text as T

SAMPLES = [
    None, "", "   ", "  ", "plain words here", "  edge\tcases\n\nand\x1cmore lines  ",
    "I am writing to file a complaint about fees. They charged $35!",
    "I am writing to lodge this complaint because, well. Then more",
    "This is a complaint against the bank. Text", "this is complaint regarding x. y",
    "To whom it may concern: please help", "I would like to file a complaint on XX/XX/XXXX. ok",
    "exxon XXXX XX/XX/XXXX xx/xx/xx/xx x-x xxx", "Café à la carte — naïve № 5", "a_b__c",
    "no stop i am writing to file a complaint without end", "XXXX XX/XX/XXXX !!",
]


def python_clean(text):
    text = text.lower()
    text = re.sub("|".join(T.BOILERPLATE_PATTERNS), " ", text, flags=re.I)
    text = re.sub(T.REDACTION_PATTERN, " ", text, flags=re.I)
    text = re.sub(r"[^a-z0-9.,!?'\s]", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def applied(spark, texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return df.select("i", *[make(F.col("t")).alias(name) for name, make in columns.items()]).orderBy("i").collect()


def test_white_space_is_that_of_python():
    assert set(T.WHITESPACE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_text_functions_equal_python(spark):
    rows = applied(
        spark, SAMPLES, clean=T.clean_narrative, words=T.word_count, strip=T.strip, has=T.has_text
    )
    for row, text in zip(rows, SAMPLES):
        assert row.has == bool(text and text.strip())
        if text is None:
            assert row.clean is None and row.words is None and row.strip is None
        else:
            assert row.clean == python_clean(text)
            assert row.words == len(text.split())
            assert row.strip == text.strip()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(alphabet=st.sampled_from(list("xX/ab .,'!\t\n_-é \x1f9")) , max_size=40), min_size=20, max_size=40
    )
)
def test_cleaning_equals_python_on_any_text(spark, texts):
    rows = applied(spark, texts, clean=T.clean_narrative, words=T.word_count)
    assert [r.clean for r in rows] == [python_clean(t) for t in texts]
    assert [r.words for r in rows] == [len(t.split()) for t in texts]


def test_clean_word_count(spark):
    rows = applied(spark, ["", "one", "one two three"], n=T.clean_word_count)
    assert [r.n for r in rows] == [0, 1, 3]


@pytest.mark.parametrize(
    "label, category",
    [
        ("Credit card or prepaid card", "Credit Card"),
        ("CREDIT CARD", "Credit Card"),
        ("Payday loan, title loan, or personal loan", "Personal Loan"),
        ("Consumer Loan", "Personal Loan"),
        ("Checking or savings account", "Savings Account"),
        ("Bank account or service", "Savings Account"),
        ("Money transfer, virtual currency, or money service", "Money Transfer"),
        ("credit card and money transfer", "Credit Card"),
        ("Mortgage", None),
        (None, None),
    ],
)
def test_map_product(spark, label, category):
    assert applied(spark, [label], c=T.map_product)[0].c == category


def test_truncate(spark):
    texts = ["short", "a\nb ", "x" * 200, "w " * 100, "y" * 160]
    rows = applied(spark, texts, t=T.truncate)
    for row, text in zip(rows, texts):
        line = text.replace("\n", " ").strip()
        assert row.t == (line if len(line) <= 160 else line[:160].rstrip() + "...")


def test_issue_label(spark):
    rows = applied(spark, ["a" * 30, "a" * 31], t=T.issue_label)
    assert [r.t for r in rows] == ["a" * 30, "a" * 30 + "..."]


def test_round_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(T.round_even(F.col("x"))).collect()] == [2.0, 4.0, -0.0, 2.0]
    df = spark.createDataFrame([(0.125,), (0.375,), (1.0,)], "x double")
    assert [r[0] for r in df.select(T.round_even(F.col("x"), 2)).collect()] == [0.12, 0.38, 1.0]
