import numpy as np
import pytest

from complaintlens.operators import dashboard, prepare, profile

ROWS = [
    (1, "Credit card", "I was charged a fee twice and nobody helped", " Fee ", "A", "CA"),
    (2, "Credit card", None, "Fee", "A", "TX"),
    (3, "Credit card", "   ", "Fee", "B", None),
    (4, "Mortgage", "a long story about a house and a bank", "Rate", "B", "CA"),
    (5, None, "text without product here", "Rate", None, ""),
    (6, "Money transfer", "XXXX XX/XX/XXXX !!", "", "C", "CA"),
    (7, "Savings account", "my savings are gone", "   ", "C", "NY"),
    (8, "Personal loan", "loan not paid out at all", None, "A", "NY"),
    (9, "Credit card", "wrong interest on my card", "Interest", "A", "NY"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        ROWS, "complaint_id long, product string, narrative string, issue string, company string, state string"
    )


def test_prepare_keeps_usable_rows(raw):
    kept = prepare.prepare_complaints(raw)
    assert [r.complaint_id for r in kept.orderBy("complaint_id").collect()] == [1, 7, 8, 9]
    assert dict(kept.select("complaint_id", "clean_word_count").collect()) == {1: 9, 7: 4, 8: 6, 9: 5}


def test_prepare_cleans_each_text_once(raw):
    plan = prepare.prepare_complaints(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(") == 1


def test_filter_funnel(raw):
    row = profile.filter_funnel(raw).first()
    assert (row.n_rows, row.after_product, row.after_text, row.near_empty, row.n_final) == (9, 7, 5, 1, 4)
    assert row.n_removed == 4 and row.share_removed == pytest.approx(4 / 9)


def test_coverage_and_missing(raw):
    row = profile.narrative_coverage(raw).first()
    assert (row.n_with, row.n_without, row.n_total) == (7, 2, 9)
    missing = dict(profile.pct_missing(raw).collect())
    assert missing == {c: 11.11 for c in ("product", "narrative", "issue", "company", "state")}
    assert "complaint_id" not in missing


def test_column_profile(raw):
    found = {r.column_name: (r.non_null, r.dtype) for r in profile.column_profile(raw).collect()}
    assert found["complaint_id"] == (9, "bigint") and found["state"] == (8, "string")


def test_counts_and_shares_leave_nulls_out(raw):
    assert profile.value_counts(raw, "product").first() == ("Credit card", 4)
    shares = dict(profile.value_shares(raw, "company").select("company", "share").collect())
    assert shares == {"A": 0.5, "B": 0.25, "C": 0.25}


def test_mapped_counts(raw):
    counts = dict(profile.mapped_counts(prepare.with_product_category(raw)).collect())
    assert counts == {"Credit Card": 4, "Money Transfer": 1, "Savings Account": 1, "Personal Loan": 1, None: 2}


@pytest.fixture
def lengths(spark):
    words = np.random.default_rng(3).geometric(0.02, size=700)
    df = spark.createDataFrame([(i, "w " * int(n)) for i, n in enumerate(words)], "id long, narrative string")
    return words, df.repartition(5)


def test_word_statistics_equal_numpy(lengths):
    words, df = lengths
    row = profile.word_count_stats(df).first()
    assert row.n_texts == len(words) and (row.min_words, row.max_words) == (words.min(), words.max())
    assert row.mean_words == pytest.approx(words.mean())
    assert row.std_words == pytest.approx(words.std(ddof=1))
    for name, share in profile.PERCENTILES.items():
        assert row[name] == pytest.approx(np.quantile(words, share))


def test_tails_histogram_box_equal_numpy(lengths):
    words, df = lengths
    p99 = np.quantile(words, 0.99)
    tails = profile.tail_counts(df).first()
    assert (tails.n_short, tails.n_long) == ((words < 5).sum(), (words > p99).sum())
    assert profile.long_narratives(df, "id").count() == tails.n_long
    counts, edges = np.histogram(words, bins=80)
    bins = {r.bin: (r.n, r.bin_start) for r in profile.word_histogram(df).collect()}
    assert {i + 1: n for i, n in enumerate(counts) if n} == {b: n for b, (n, _) in bins.items()}
    assert all(start == pytest.approx(edges[b - 1]) for b, (_, start) in bins.items())
    q1, q3 = np.quantile(words, [0.25, 0.75])
    inside = words[(words >= q1 - 1.5 * (q3 - q1)) & (words <= q3 + 1.5 * (q3 - q1))]
    box = profile.box_stats(df).first()
    assert (box.q1, box.q3) == (q1, q3)
    assert (box.whisker_low, box.whisker_high) == (inside.min(), inside.max())
    assert box.n_outliers == len(words) - len(inside)


def test_histogram_of_one_length(spark):
    df = spark.createDataFrame([("a b",), ("c d",)], "narrative string")
    assert [(r.bin, r.n) for r in profile.word_histogram(df).collect()] == [(1, 2)]


def test_statistics_without_any_text(spark):
    df = spark.createDataFrame([(None,), (" ",)], "narrative string")
    row = profile.word_count_stats(df).first()
    assert row.n_texts == 0 and row.mean_words is None
    assert profile.tail_counts(df).first().n_short == 0


def test_eda_summary(raw):
    row = profile.eda_summary(raw).first()
    assert (row.total, row.n_products, row.top_product, row.top_product_n) == (9, 5, "Credit card", 4)
    assert (row.n_with, row.n_without, row.n_short, row.n_kept) == (7, 2, 3, 4)
    assert row.median_words == 5.0


def test_dashboard(raw):
    df = prepare.with_product_category(raw)
    assert [(r.product_category, r.n) for r in dashboard.product_volume(df).collect()] == [
        ("Credit Card", 4), ("Personal Loan", 1), ("Savings Account", 1), ("Money Transfer", 1),
    ]
    assert [(r.company, r.n, r["rank"]) for r in dashboard.top_companies(df, n=2).orderBy("rank").collect()] == [
        ("A", 4, 1), ("B", 2, 2),
    ]
    states = {r.state: r.n for r in dashboard.state_distribution(df).collect()}
    assert states == {"CA": 3, "NY": 3, "TX": 1, "": 1}
    issues = [(r.product_category, r.issue, r.n, r["rank"]) for r in dashboard.top_issues(df).orderBy("rank").collect()]
    assert issues == [("Credit Card", "Fee", 3, 1), ("Credit Card", "Interest", 1, 2)]


def test_kpis_and_placeholders(raw):
    df = prepare.with_product_category(raw)
    assert dashboard.kpis(df).first().asDict() == {
        "n_rows": 9, "n_products": 4, "n_companies": 3, "n_states": 4,
    }
    bare = dashboard.kpis(raw.select("complaint_id", "state")).first()
    assert (bare.n_rows, bare.n_products, bare.n_companies, bare.n_states) == (9, "4", "—", 4)
    assert dashboard.kpis(raw.select("complaint_id")).first().n_rows == 9


def test_previews(raw):
    usable = prepare.filter_with_text(prepare.filter_mapped(prepare.with_product_category(raw)))
    preview = prepare.before_after_preview(usable, "complaint_id", n=1, width=10)
    assert preview.collect() == [(1, "I was char", "i was char")]
    short = profile.short_narratives(raw, "complaint_id", n=2).collect()
    assert [r.complaint_id for r in short] == [5, 6]
