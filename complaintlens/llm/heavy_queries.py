"""Queries for classifiers, near-duplicates, repeated passages, decontamination and language-model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from complaintlens.llm import decontamination, near_duplicates, ngram_scores, quality, repeats, toxicity
from complaintlens.llm.registry import query, table


@query("op1_suffix_dedup")
def suffix_dedup(spark, folder):
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_toxicity")
def toxicity_scores(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_quality")
def quality_scores(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


ITEMS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT item_id, size, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bk, unnest(range(1, size - k + 2)) u(i)),
bc AS (SELECT item_id, size, k, g, count(*) AS c FROM bg GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM bk),
dg AS (SELECT doc_id, len(w) AS n, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) u(i)),
shared AS (SELECT DISTINCT doc_id, n, pos, item_id, size, k FROM dg JOIN bc USING (k, g)),
starts AS (SELECT DISTINCT doc_id, item_id, size, k, least(pos, greatest(n - size, 0)) AS start FROM shared),
inside AS (SELECT s.doc_id, s.item_id, s.size, s.start, s.k, g, count(*) AS c FROM starts s JOIN dg ON dg.doc_id = s.doc_id AND dg.k = s.k AND dg.pos BETWEEN s.start AND s.start + s.size - s.k GROUP BY ALL),
scored AS (SELECT i.doc_id, i.item_id, i.size, i.start, sum(least(i.c, coalesce(bc.c, 0))) AS common, sum(i.c) AS weight
  FROM inside i LEFT JOIN bc ON bc.item_id = i.item_id AND bc.g = i.g GROUP BY ALL),
alike AS (SELECT doc_id, item_id, size, start, common / (weight + (size - least(size, 5) + 1) - common) AS similarity FROM scored)
SELECT doc_id, item_id, start::BIGINT AS first_word, size::BIGINT AS n_words, similarity::DOUBLE AS similarity FROM alike WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@query("op4_decontamination", ITEMS_SQL)
def contaminated(spark, folder):
    return decontamination.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("hamming")


LM_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pairs AS (SELECT doc_id, CASE WHEN i = 1 THEN NULL ELSE w[i - 1] END AS a, w[i] AS b FROM d, unnest(range(1, len(w) + 1)) u(i)),
counted AS (SELECT doc_id, count(*) OVER (PARTITION BY a, b) AS n_both, count(*) OVER (PARTITION BY a) AS firsts, count(*) OVER (PARTITION BY b) AS seconds, count(*) OVER () AS n FROM pairs),
scored AS (SELECT doc_id, count(*) AS n_words,
    sum(round(16777216 * CASE WHEN n_both >= 2 THEN ln(n_both) - ln(firsts) ELSE (ln(0.4) + ln(seconds)) - ln(n) END)::BIGINT)::DOUBLE / 16777216 AS log_score
  FROM counted GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(log_score, 0.0) AS log_score, coalesce(log_score / n_words, 0.0) AS mean_log_score
FROM d LEFT JOIN scored USING (doc_id)
"""


@query("op5_lm_scores", LM_SQL)
def lm_scores(spark, folder):
    return ngram_scores.score_documents(table(spark, folder, "documents"))


@query("op7_near_duplicates")
def near_duplicate_groups(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))
