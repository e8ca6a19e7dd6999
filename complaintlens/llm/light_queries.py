"""Queries for license scans, chat formatting, mixing and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from complaintlens.llm import chat, licenses, mixing, quality_rules
from complaintlens.llm.registry import query, table

# White space between words and the words of a text, in DuckDB.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LICENSES_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
templates AS (SELECT row_number() OVER () AS tpl, label, exact, string_split(words, ' ') AS t FROM (VALUES
  {templates}) v(words, label, exact)),
tgrams AS (SELECT tpl, label, exact, len(t) - 2 AS grams, len(t) AS length, i - 1 AS t, t[i] AS a, t[i + 1] AS b, t[i + 2] AS c
  FROM templates, unnest(range(1, len(t) - 1)) u(i)),
grams AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM lowered, unnest(range(1, len(w) - 1)) u(i)),
votes AS (SELECT DISTINCT doc_id, tpl, label, exact, grams, length, pos - t AS diagonal, t FROM grams JOIN tgrams USING (a, b, c)),
diagonals AS (SELECT DISTINCT doc_id, tpl, exact, diagonal FROM votes),
marked AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER o > 3, true) THEN 1 ELSE 0 END AS apart
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, tpl ORDER BY diagonal)),
bands AS (SELECT doc_id, tpl, diagonal, sum(apart) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS band FROM marked),
spans0 AS (SELECT doc_id, tpl, label, exact, band, count(DISTINCT t) / any_value(grams)::DOUBLE AS share, min(diagonal) AS first,
    max(diagonal) - min(diagonal) AS drift, any_value(length) AS length
  FROM votes JOIN bands USING (doc_id, tpl, diagonal) GROUP BY doc_id, tpl, label, exact, band),
spans AS (SELECT doc_id, tpl, label, exact, band, first,
    CASE WHEN exact OR drift <= greatest(3, floor(length * 0.2 + 1e-9)) THEN share ELSE 0.0 END AS share FROM spans0),
found AS (SELECT doc_id,
    count(*) FILTER (exact AND share = 1) AS n_base,
    min(first) FILTER (exact AND share = 1) AS first_word, max(first) FILTER (exact AND share = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND share = 1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= CASE WHEN exact THEN 1 ELSE 0.8 END) AS labels,
    max(share) AS score
  FROM spans GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM lowered LEFT JOIN found USING (doc_id)
""".format(
    templates=",\n  ".join(
        f"('{words}', '{label}', {exact})" for templates, exact in ((licenses.PHRASES, "true"), (licenses.NOTICES, "false")) for words, label in templates.items()
    )
)

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
levels AS (SELECT conv_id, bool_or(contains(text, '<|') OR contains(role, '<|') OR contains(role, chr(10))) AS escaped FROM rows GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (10 + sum(17 + length(role) + length(text)
    + CASE WHEN escaped THEN length(replace(replace(text, '\', '\s'), '<|', '<\p')) - length(text)
        + length(replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n')) - length(role) ELSE 0 END))::BIGINT AS formatted_chars
FROM rows JOIN levels USING (conv_id) GROUP BY conv_id
"""

MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source),
ranked AS (SELECT *, source_size::DOUBLE * 3 AS most, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights FROM sources),
units AS (SELECT *, (total - coalesce(sum(most) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS unit
  FROM ranked WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(most, weight * max(unit) OVER ()) AS target FROM units),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized)
SELECT doc_id, r.source, size, source_size, target, (size * (copies + (upto <= target - copies * source_size)::BIGINT))::BIGINT AS taken
FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
"""

RULES_SQL = rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
counted AS (
  SELECT doc_id, text, w, len(w) AS n_words, len(list_distinct(w)) AS n_distinct,
    length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS small,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM split),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM counted, unnest(range(1, n_words - 6)) u(i) WHERE n_distinct < n_words),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(8) r(j) GROUP BY doc_id),
facts AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat
  FROM counted LEFT JOIN repeated USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words
    OR capitals > small OR 4 * n_marks > n_words OR 20 * n_distinct < n_words) AS kept
FROM based
"""


@query("op6_license_scan", LICENSES_SQL)
def license_scan(spark, folder):
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.drop("spans")


@query("op8_chat_format", CHAT_SQL)
def chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows.unionByName(added))
    turns = chat.read_turns(chats.withColumn("chars", F.length("formatted")))
    ordered = F.array_sort(F.collect_list(F.struct("i", "role", "text", "in_loss")))
    read = turns.groupBy("conv_id").agg(ordered.alias("turns"), (F.max(F.col("start") + F.col("length")) - 1).alias("upto"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), (F.col("upto") + len(chat.END)).cast("long").alias("formatted_chars"),
    )


@query("op9_source_mix", MIX_SQL)
def source_mix(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op10_quality_rules", RULES_SQL)
def rules(spark, folder):
    return quality_rules.apply_quality_rules(table(spark, folder, "documents"))
