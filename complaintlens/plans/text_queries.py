"""Registered queries on complaints: preparation, profile, dashboard, sampling, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from complaintlens.functions import text as T
from complaintlens.operators import chunking, dashboard, frequent, prepare, profile, sampling, sketches
from complaintlens.plans import inputs as I
from complaintlens.plans.registry import query
from complaintlens.session import scratch_dir

SAMPLE_TARGET = 120


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- preparation -----------------------------------------------------------


@query(
    "map_product",
    f"{I.WITH_CC} SELECT complaint_id, product, product_category FROM mapped",
)
def map_product(spark, folder):
    cc = I.complaints(spark, folder)
    return prepare.with_product_category(cc).select("complaint_id", "product", "product_category")


@query(
    "clean_narrative",
    f"{I.WITH_CC} SELECT complaint_id, {I.sql_clean('narrative')} AS clean_narrative FROM cc "
    f"WHERE {I.sql_has_text('narrative')}",
)
def clean_narrative(spark, folder):
    cc = prepare.filter_with_text(I.complaints(spark, folder))
    return cc.select("complaint_id", T.clean_narrative(F.col("narrative")).alias("clean_narrative"))


@query(
    "word_counts",
    f"SELECT doc_id, CAST({I.sql_words('text')} AS INTEGER) AS word_count FROM documents",
)
def word_counts(spark, folder):
    docs = I.documents(spark, folder)
    return docs.select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query(
    "clean_filtered",
    f"{I.WITH_CLEAN} SELECT complaint_id, product_category, clean_narrative, clean_word_count FROM clean",
)
def clean_filtered(spark, folder):
    return I.cleaned(spark, folder).select(
        "complaint_id", "product_category", "clean_narrative", "clean_word_count"
    )


@query(
    "clean_preview",
    f"{I.WITH_CLEAN} SELECT complaint_id, substring(narrative, 1, 200) AS before, "
    "substring(clean_narrative, 1, 200) AS after FROM usable ORDER BY complaint_id LIMIT 2",
)
def clean_preview(spark, folder):
    usable = prepare.filter_with_text(prepare.filter_mapped(I.mapped(spark, folder)))
    return prepare.before_after_preview(usable, "complaint_id")


_BOLD = "concat('**', product, '**: ', narrative, ' **', company, '**')"


@query(
    "markdown_bold",
    f"{I.WITH_CC} SELECT complaint_id, concat('<div class=\"answer-text\">', "
    rf"regexp_replace({_BOLD}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '</div>') AS html FROM cc "
    "WHERE product IS NOT NULL AND narrative IS NOT NULL",
)
def markdown_bold(spark, folder):
    from complaintlens.operators.prompts import rendered_answer

    cc = I.complaints(spark, folder).filter("product IS NOT NULL AND narrative IS NOT NULL")
    return cc.select("complaint_id", rendered_answer(F.expr(_BOLD)).alias("html"))


# --- profile ---------------------------------------------------------------


@query(
    "product_counts",
    f"{I.WITH_CC} SELECT product, count(*) AS n FROM cc WHERE product IS NOT NULL GROUP BY product",
)
def product_counts(spark, folder):
    return profile.value_counts(I.complaints(spark, folder), "product")


@query(
    "mapped_counts",
    f"{I.WITH_CC} SELECT product_category, count(*) AS n FROM mapped GROUP BY product_category",
)
def mapped_counts(spark, folder):
    return profile.mapped_counts(I.mapped(spark, folder))


@query(
    "category_shares",
    f"""{I.WITH_CC} SELECT product_category, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM mapped WHERE product_category IS NOT NULL GROUP BY product_category""",
)
def category_shares(spark, folder):
    return rounded(profile.value_shares(I.mapped(spark, folder), "product_category"), "share")


_MAPPED_COLUMNS = [
    ("complaint_id", "bigint"), ("narrative", "string"), ("product", "string"), ("issue", "string"),
    ("company", "string"), ("state", "string"), ("date_received", "string"), ("product_category", "string"),
]


@query(
    "pct_missing",
    f"{I.WITH_CC} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round_even(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        f" * 100.0::DOUBLE, 2) AS pct_missing FROM mapped"
        for c, _ in _MAPPED_COLUMNS
    )
    + ") WHERE pct_missing > 0",
)
def pct_missing(spark, folder):
    return profile.pct_missing(I.mapped(spark, folder))


@query(
    "column_profile",
    f"{I.WITH_CC} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM mapped"
        for c, t in _MAPPED_COLUMNS
    ),
)
def column_profile(spark, folder):
    return profile.column_profile(I.mapped(spark, folder))


_WORDS = f"""{I.WITH_CC}, words AS (SELECT complaint_id, narrative, {I.sql_words('narrative')} AS w
FROM cc WHERE {I.sql_has_text('narrative')}),
p AS (SELECT quantile_cont(w, 0.99) AS p99, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.5) AS q2,
  quantile_cont(w, 0.75) AS q3, min(w) AS lo, max(w) AS hi FROM words)"""


@query(
    "word_count_stats",
    f"""{_WORDS} SELECT count(*) AS n_texts, round(avg(w), 6) AS mean_words,
  round(stddev_samp(w), 6) AS std_words, min(w) AS min_words, max(w) AS max_words, """
    + ", ".join(
        f"CAST(quantile_cont(w, {share}) AS DOUBLE) AS {name}"
        for name, share in profile.PERCENTILES.items()
    )
    + " FROM words",
)
def word_count_stats(spark, folder):
    return rounded(profile.word_count_stats(I.complaints(spark, folder)), "mean_words", "std_words")


@query(
    "tail_counts",
    f"""{_WORDS} SELECT count(*) FILTER (w < 5) AS n_short, count(*) FILTER (w > p99) AS n_long,
  CAST(any_value(p99) AS DOUBLE) AS long_threshold FROM words, p""",
)
def tail_counts(spark, folder):
    return profile.tail_counts(I.complaints(spark, folder))


@query(
    "short_narratives",
    f"""{_WORDS} SELECT complaint_id, narrative, CAST(w AS INTEGER) AS word_count
FROM words WHERE w < 5 ORDER BY complaint_id LIMIT 5""",
)
def short_narratives(spark, folder):
    return profile.short_narratives(I.complaints(spark, folder), "complaint_id")


@query(
    "long_narratives",
    f"{_WORDS} SELECT complaint_id, CAST(w AS INTEGER) AS word_count FROM words, p WHERE w > p99",
)
def long_narratives(spark, folder):
    return profile.long_narratives(I.complaints(spark, folder), "complaint_id")


@query(
    "narrative_coverage",
    f"""{I.WITH_CC}, c AS (SELECT count(*) FILTER ({I.sql_has_text('narrative')}) AS w, count(*) AS t FROM cc)
SELECT w AS n_with, t - w AS n_without, t AS n_total, round(w::DOUBLE / t, 6) AS share_with,
  round((t - w)::DOUBLE / t, 6) AS share_without FROM c""",
)
def narrative_coverage(spark, folder):
    return rounded(
        profile.narrative_coverage(I.complaints(spark, folder)), "share_with", "share_without"
    )


@query(
    "filter_funnel",
    f"""{I.WITH_CLEAN}, c AS (SELECT (SELECT count(*) FROM cc) AS a,
  (SELECT count(*) FROM mapped WHERE product_category IS NOT NULL) AS b,
  (SELECT count(*) FROM usable) AS c, (SELECT count(*) FROM clean) AS d)
SELECT a AS n_rows, b AS after_product, c AS after_text, a - c AS n_removed,
  round((a - c)::DOUBLE / a, 6) AS share_removed, c - d AS near_empty, d AS n_final FROM c""",
)
def filter_funnel(spark, folder):
    return rounded(profile.filter_funnel(I.complaints(spark, folder)), "share_removed")


@query(
    "filtered_counts",
    f"{I.WITH_CLEAN} SELECT product_category, count(*) AS n FROM usable GROUP BY product_category",
)
def filtered_counts(spark, folder):
    usable = prepare.filter_with_text(prepare.filter_mapped(I.mapped(spark, folder)))
    return profile.value_counts(usable, "product_category")


@query(
    "word_histogram",
    f"""{_WORDS}, b AS (SELECT CAST(least(floor((w - lo) * 80.0::DOUBLE / (hi - lo)) + 1, 80) AS INTEGER) AS bin,
  lo, hi, p99 FROM words, p)
SELECT bin, count(*) AS n, round(lo + (bin - 1) * (hi - lo) / 80.0::DOUBLE, 6) AS bin_start,
  lo + (bin - 1) * (hi - lo) / 80.0::DOUBLE <= p99 AS in_view FROM b GROUP BY bin, lo, hi, p99""",
)
def word_histogram(spark, folder):
    return rounded(profile.word_histogram(I.complaints(spark, folder)), "bin_start")


@query(
    "box_stats",
    f"""{_WORDS} SELECT CAST(any_value(q1) AS DOUBLE) AS q1, CAST(any_value(q2) AS DOUBLE) AS median,
  CAST(any_value(q3) AS DOUBLE) AS q3,
  min(w) FILTER (w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(w) FILTER (w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers,
  CAST(any_value(p99) AS DOUBLE) AS view_limit FROM words, p""",
)
def box_stats(spark, folder):
    return profile.box_stats(I.complaints(spark, folder))


@query(
    "eda_summary",
    f"""{I.WITH_CLEAN}, words AS (SELECT {I.sql_words('narrative')} AS w FROM cc WHERE {I.sql_has_text('narrative')}),
t AS (SELECT count(*) AS total, count(DISTINCT product) AS n_products FROM cc),
top AS (SELECT product, count(*) AS n FROM cc WHERE product IS NOT NULL GROUP BY product
  ORDER BY n DESC, product LIMIT 1),
s AS (SELECT count(*) AS n_with, quantile_cont(w, 0.5) AS med, quantile_cont(w, 0.99) AS p99,
  count(*) FILTER (w < 5) AS n_short FROM words),
k AS (SELECT count(*) AS n_kept FROM clean)
SELECT total, n_products, product AS top_product, n AS top_product_n, round(n::DOUBLE / total, 6) AS top_product_share,
  n_with, total - n_with AS n_without, round(n_with::DOUBLE / total, 6) AS share_with,
  CAST(med AS DOUBLE) AS median_words, CAST(p99 AS DOUBLE) AS p99_words, n_short, n_kept,
  round(n_kept::DOUBLE / total, 6) AS share_kept FROM t, top, s, k""",
)
def eda_summary(spark, folder):
    return rounded(
        profile.eda_summary(I.complaints(spark, folder)),
        "top_product_share", "share_with", "share_kept",
    )


# --- dashboard -------------------------------------------------------------


@query(
    "product_volume",
    f"""{I.WITH_CLEAN} SELECT product_category, count(*) AS n,
  list_position([{', '.join(I.sql_text(p) for p in T.PRODUCTS)}], product_category)::BIGINT AS position
FROM clean GROUP BY product_category""",
)
def product_volume(spark, folder):
    return dashboard.product_volume(I.cleaned(spark, folder))


def _top_sql(column: str, n: int) -> str:
    return f"""{I.WITH_CLEAN} SELECT {column}, count(*) AS n,
  CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank
FROM clean WHERE {column} IS NOT NULL GROUP BY {column} QUALIFY rank <= {n}"""


@query("top_companies", _top_sql("company", 10))
def top_companies(spark, folder):
    return dashboard.top_companies(I.cleaned(spark, folder))


@query("top_companies_frequent", _top_sql("company", 10))
def top_companies_frequent(spark, folder):
    """top_companies from per-task frequent-value summaries, candidates counted exactly, the top proven complete."""
    return frequent.top_frequent(I.cleaned(spark, folder), "company", 10)


@query("state_distribution", _top_sql("state", 15))
def state_distribution(spark, folder):
    return dashboard.state_distribution(I.cleaned(spark, folder))


@query(
    "top_issues",
    f"""{I.WITH_CLEAN}, i AS (SELECT product_category, {I.sql_strip('issue')} AS issue FROM clean),
g AS (SELECT product_category, issue, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY product_category ORDER BY count(*) DESC, issue) AS INTEGER) AS rank
  FROM i WHERE issue <> '' GROUP BY product_category, issue)
SELECT *, CASE WHEN length(issue) > 30 THEN concat(issue[1:30], '...') ELSE issue END AS label
FROM g WHERE rank <= 5""",
)
def top_issues(spark, folder):
    return dashboard.top_issues(I.cleaned(spark, folder))


@query(
    "kpis",
    f"""{I.WITH_CLEAN} SELECT count(*) AS n_rows, count(DISTINCT product_category) AS n_products,
  count(DISTINCT company) AS n_companies, count(DISTINCT state) AS n_states FROM clean""",
)
def kpis(spark, folder):
    return dashboard.kpis(I.cleaned(spark, folder))


@query(
    "kpis_sketched",
    f"""{I.WITH_CLEAN} SELECT count(*) AS n_rows, count(DISTINCT product_category) AS n_products,
  count(DISTINCT company) AS n_companies, count(DISTINCT state) AS n_states FROM clean""",
)
def kpis_sketched(spark, folder):
    """The cards from sketches per day: the days before the last are stored first, the last one appended, then united."""
    cleaned = I.cleaned(spark, folder)
    columns = ["product_category", "company", "state"]
    last = cleaned.agg(F.max("date_received")).first()[0]
    path = scratch_dir(spark, "day-sketches")
    earlier = F.col("date_received").isNull() | (F.col("date_received") < F.lit(last))
    sketches.period_sketches(cleaned.filter(earlier), "date_received", columns).write.parquet(path)
    # A new day is added without reading the earlier ones again.
    sketches.period_sketches(cleaned.filter(~earlier), "date_received", columns).write.mode("append").parquet(path)
    return sketches.kpis_sketched(spark.read.parquet(path))


# --- sampling --------------------------------------------------------------

_TARGETS = f"""{I.WITH_CLEAN}, g AS (SELECT product_category, count(*) AS n FROM clean GROUP BY product_category),
targets AS (SELECT product_category, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM g),
t AS (SELECT *, least(CAST(round_even(share * {SAMPLE_TARGET}::DOUBLE, 0) AS BIGINT), n) AS target FROM targets)"""
SAMPLE_SQL = f"""{_TARGETS}, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY product_category
  ORDER BY md5(concat('42:', CAST(complaint_id AS VARCHAR))), complaint_id) AS rk FROM clean c),
sample AS (SELECT ranked.* FROM ranked JOIN t USING (product_category) WHERE rk <= target)"""


@query(
    "stratified_targets",
    f"{_TARGETS} SELECT product_category, n, round(share, 6) AS share, target FROM t",
)
def stratified_targets(spark, folder):
    targets = sampling.stratified_targets(I.cleaned(spark, folder), "product_category", SAMPLE_TARGET)
    return rounded(targets, "share")


@query("stratified_sample", f"{SAMPLE_SQL} SELECT complaint_id, product_category, clean_narrative FROM sample")
def stratified_sample(spark, folder):
    return sampling.stratified_sample(
        I.stored_cleaned(spark, folder), "product_category", SAMPLE_TARGET, "complaint_id"
    ).select("complaint_id", "product_category", "clean_narrative")


@query(
    "sampling_summary",
    f"""{SAMPLE_SQL}, o AS (SELECT product_category, count(*) AS original_n FROM clean GROUP BY product_category),
m AS (SELECT product_category, count(*) AS sample_n FROM sample GROUP BY product_category)
SELECT product_category, original_n, sample_n,
  round_even(original_n / CAST(sum(original_n) OVER () AS DOUBLE) * 100.0::DOUBLE, 2) AS original_pct,
  round_even(sample_n / CAST(sum(sample_n) OVER () AS DOUBLE) * 100.0::DOUBLE, 2) AS sample_pct
FROM o FULL JOIN m USING (product_category)""",
)
def sampling_summary(spark, folder):
    original = I.stored_cleaned(spark, folder)
    sample = sampling.stratified_sample(original, "product_category", SAMPLE_TARGET, "complaint_id")
    return sampling.sampling_summary(original, sample, "product_category")


# --- chunking --------------------------------------------------------------


_CHUNKS = f"base AS (SELECT complaint_id AS id, clean_narrative AS text FROM clean), {I.sql_chunks('base', 500, 50)}"


@query(
    "chunk_documents",
    I.recursive(
        f"""{I.WITH_CLEAN}, {_CHUNKS} SELECT concat(id, '_', chunk_index) AS chunk_id, complaint_id, chunk_index,
  total_chunks, chunk_text, product_category, company, state FROM chunks JOIN clean ON id = complaint_id"""
    ),
)
def chunk_documents(spark, folder):
    return chunking.chunk_documents(
        I.cleaned(spark, folder), "clean_narrative", "complaint_id", ["product_category", "company", "state"]
    )


@query(
    "chunk_invariants",
    f"""SELECT doc_id, true AS has_chunks, true AS numbered_through, true AS totals_agree,
  true AS none_too_long, true AS none_blank, regexp_extract(text, {I.sql_text(I.NOT_WS + '+')}) AS first_word,
  regexp_extract(text, {I.sql_text('(' + I.NOT_WS + '+)' + I.WS + '*$')}, 1) AS last_word
FROM documents WHERE {I.sql_has_text('text')}""",
)
def chunk_invariants(spark, folder):
    """Per document with text, what must hold of its chunks, and the words they begin and end with."""
    docs = I.documents(spark, folder)
    chunks = chunking.chunk_documents(docs, "text", "doc_id")
    return chunks.groupBy(F.col("complaint_id").alias("doc_id")).agg(
        (F.count(F.lit(1)) > 0).alias("has_chunks"),
        (
            (F.min("chunk_index") == 0)
            & (F.max("chunk_index") == F.count(F.lit(1)) - 1)
            & (F.sum("chunk_index") * 2 == F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))
        ).alias("numbered_through"),
        (
            (F.min("total_chunks") == F.count(F.lit(1))) & (F.max("total_chunks") == F.count(F.lit(1)))
        ).alias("totals_agree"),
        (F.max(F.length("chunk_text")) <= chunking.DEFAULT_CHUNK_SIZE).alias("none_too_long"),
        (F.min(F.length(T.strip(F.col("chunk_text")))) > 0).alias("none_blank"),
        F.regexp_extract(F.min_by("chunk_text", "chunk_index"), f"{I.NOT_WS}+", 0).alias("first_word"),
        F.regexp_extract(F.max_by("chunk_text", "chunk_index"), f"({I.NOT_WS}+){I.WS}*$", 1).alias("last_word"),
    )


@query(
    "chunk_reassembly",
    f"SELECT doc_id, md5(regexp_replace(text, {I.sql_text(I.WS)}, '', 'g')) AS digest FROM documents "
    f"WHERE {I.sql_has_text('text')}",
)
def chunk_reassembly(spark, folder):
    """Without overlap the chunks of a text join to that text, white space aside."""
    docs = I.documents(spark, folder)
    pieces = chunking.splitter(overlap=0)
    joined = F.regexp_replace(F.array_join(pieces(F.col("text")), ""), I.WS, "")
    return docs.filter(T.has_text(F.col("text"))).select(
        "doc_id", F.md5(joined.cast("binary")).alias("digest")
    )


@query(
    "chunk_stats",
    I.recursive(
        f"""{SAMPLE_SQL}, base AS (SELECT complaint_id AS id, clean_narrative AS text FROM sample),
{I.sql_chunks('base', 500, 50)},
n AS (SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM sample) AS n_complaints)
SELECT n_chunks, n_complaints, round(n_chunks::DOUBLE / n_complaints, 6) AS chunks_per_complaint FROM n"""
    ),
)
def chunk_stats(spark, folder):
    sample = sampling.stratified_sample(
        I.stored_cleaned(spark, folder), "product_category", SAMPLE_TARGET, "complaint_id"
    )
    chunks = chunking.chunk_documents(sample, "clean_narrative", "complaint_id")
    return rounded(chunking.chunk_stats(chunks, sample), "chunks_per_complaint")


@query(
    "short_texts",
    f"""{I.WITH_CC} SELECT complaint_id, CASE WHEN length(narrative) > 30
  THEN concat(substring(narrative, 1, 30), '...') ELSE narrative END AS label,
  CASE WHEN length(s) > 160 THEN concat(rtrim(substring(s, 1, 160)), '...') ELSE s END AS line
FROM (SELECT complaint_id, narrative, {I.sql_strip("replace(narrative, chr(10), ' ')")} AS s FROM cc)""",
)
def short_texts(spark, folder):
    """Short forms of a text: cut at 30 characters, and on one line cut at 160."""
    return I.complaints(spark, folder).select(
        "complaint_id",
        T.issue_label(F.col("narrative")).alias("label"),
        T.truncate(F.col("narrative")).alias("line"),
    )
