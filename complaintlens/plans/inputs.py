"""Inputs of the registered queries, as DataFrames and as SQL for the comparison.

There is no complaint table among the test tables, so ``complaints`` derives one from all
documents, with missing, blank, boilerplate, redacted and unmapped cases at fixed places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.functions import text as T
from complaintlens.operators.prepare import prepare_complaints
from complaintlens.session import spread, written_once

COMPLAINTS_SQL = """
SELECT d.doc_id AS complaint_id,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL
       WHEN d.doc_id % 29 = 0 THEN '   '
       WHEN d.doc_id % 31 = 0 THEN 'XXXX XX/XX/XXXX !!'
       WHEN d.doc_id % 19 = 0 THEN concat('To whom it may\u00a0concern, I\u2003am writing\u3000to file a complaint about it. Paid on XX/XX/XXXX\u00a0again. ', d.text)
       WHEN d.doc_id % 5 = 0 THEN concat('To whom it may concern: I am writing to file a complaint about a fee. On XX/XX/XXXX my card XXXX1234 was charged $35. ', d.text)
       ELSE d.text END AS narrative,
  CASE WHEN d.doc_id % 17 = 0 THEN 'Debt collection'
       WHEN d.doc_id % 37 = 0 THEN NULL
       WHEN d.lang = 'en' THEN 'Credit card or prepaid card'
       WHEN d.lang = 'fr' THEN 'Payday loan, title loan, or personal loan'
       WHEN d.lang = 'de' THEN 'Checking or savings account'
       ELSE 'Money transfer, virtual currency, or money service' END AS product,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL
       WHEN d.doc_id % 7 = 0 THEN '  '
       ELSE concat(' Issue ', CAST(d.doc_id % 8 AS STRING), ' ') END AS issue,
  d.source AS company,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE n.n_name END AS state,
  concat('2024-', lpad(CAST(d.doc_id % 12 + 1 AS STRING), 2, '0'), '-15') AS date_received
FROM {documents} d JOIN {nation} n ON n.n_nationkey = d.doc_id % 25
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        COMPLAINTS_SQL,
        documents=documents(spark, folder),
        nation=table(spark, folder, "nation"),
    )


def mapped(spark: SparkSession, folder: str) -> DataFrame:
    cc = complaints(spark, folder)
    return cc.withColumn("product_category", T.map_product(F.col("product")))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_complaints(complaints(spark, folder))


def stored_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned table written and read back, for jobs that read it more than once."""
    return written_once(cleaned(spark, folder), "cleaned")


# The same in SQL.

WS = f"[{T.WHITESPACE_CLASS}]"
NOT_WS = f"[^{T.WHITESPACE_CLASS}]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_has_text(column: str) -> str:
    return f"coalesce(regexp_matches({column}, {sql_text(NOT_WS)}), false)"


def sql_words(column: str) -> str:
    return f"len(regexp_extract_all({column}, {sql_text(NOT_WS + '+')}))"


def sql_strip(column: str) -> str:
    inner = f"regexp_replace({column}, {sql_text('^' + WS + '+')}, '')"
    return f"regexp_replace({inner}, {sql_text(WS + '+$')}, '')"


def sql_clean(column: str) -> str:
    """The cleaning step by step: boilerplate, redaction, other characters, white space."""
    steps = [
        ("|".join(T.BOILERPLATE_PATTERNS)),
        T.REDACTION_PATTERN,
        r"[^a-z0-9.,!?'\s]",
        r"\s+",
    ]
    blanks = " " * len(T.WHITESPACE)
    expression = f"translate(lower({column}), {sql_text(T.WHITESPACE)}, {sql_text(blanks)})"
    for pattern in steps:
        expression = f"regexp_replace({expression}, {sql_text(pattern)}, ' ', 'g')"
    return f"trim({expression})"


def _sql_category(column: str) -> str:
    cases = [
        "WHEN " + " OR ".join(f"contains(lower({column}), {sql_text(w)})" for w in words)
        + f" THEN {sql_text(category)}"
        for category, words in T.PRODUCT_KEYWORDS.items()
    ]
    return f"CASE {' '.join(cases)} END"


_CC = COMPLAINTS_SQL.format(documents="documents", nation="nation")
WITH_CC = f"WITH cc AS ({_CC}), mapped AS (SELECT *, {_sql_category('product')} AS product_category FROM cc)"
WITH_CLEAN = f"""{WITH_CC}, usable AS (
  SELECT *, {sql_clean('narrative')} AS clean_narrative FROM mapped
  WHERE product_category IS NOT NULL AND {sql_has_text('narrative')}),
counted AS (
  SELECT *, CAST(len(regexp_extract_all(clean_narrative, '\\S+')) AS INTEGER) AS clean_word_count FROM usable),
clean AS (SELECT * FROM counted WHERE clean_word_count >= 3)"""


def sql_chunks(relation: str, size: int, overlap: int) -> str:
    """CTEs ending in ``chunks(id, chunk_index, total_chunks, chunk_text)`` for ``relation(id, text)``.

    For cleaned texts, where only sentences, blanks and single characters part the pieces.
    Pieces of one level that are packed together form a run with the running length of its
    pieces. A chunk starts at a length ``base`` and takes all pieces up to ``base + size``; the
    next one starts at the first piece that leaves at most ``overlap`` and room for one more.
    """

    def pieces(source: str, keys: str, separator: str, order: str) -> str:
        parts = f"string_split({source}.piece, '{separator}')"
        return (
            f"SELECT {keys}, i AS {order}, CASE WHEN i > 1 THEN '{separator}' || p ELSE p END AS piece FROM "
            f"(SELECT {keys}, unnest({parts}) AS p, generate_subscripts({parts}, 1) AS i FROM {source} "
            f"WHERE length(piece) >= least_length) WHERE i > 1 OR p <> ''"
        )

    def numbered(source: str, keys: str, order: str, group: str) -> str:
        return (
            f"SELECT *, {size} AS least_length, CAST(sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) "
            f"OVER (PARTITION BY {keys} ORDER BY {order}) AS BIGINT) AS {group} FROM {source}"
        )

    def runs(source: str, keys: str, order: str, place: str, condition: str) -> str:
        return (
            f"SELECT id, {place}, string_agg(piece, '' ORDER BY {order}) AS txt, list(upto ORDER BY {order}) AS cum "
            f"FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY {order}) AS BIGINT) AS upto "
            f"FROM {source} WHERE {condition}) GROUP BY {keys}"
        )

    small = f"length(piece) < {size}"
    return f"""
whole AS (SELECT id, text AS piece, 0 AS least_length FROM {relation}),
sentences AS ({pieces('whole', 'id', '. ', 'o1')}),
level1 AS ({numbered('sentences', 'id', 'o1', 'g1')}),
words AS ({pieces('level1', 'id, g1', ' ', 'o2')}),
level2 AS ({numbered('words', 'id, g1', 'o2', 'g2')}),
letters AS (SELECT id, g1, g2, unnest(string_split(piece, '')) AS piece,
  generate_subscripts(string_split(piece, ''), 1) AS o3 FROM level2 WHERE NOT {small}),
runs AS ({runs('level1', 'id, g1', 'o1', 'g1 AS a, 1 AS b, 0 AS c, 0 AS d', small)}
  UNION ALL {runs('level2', 'id, g1, g2', 'o2', 'g1, 0, g2, 1', small)}
  UNION ALL {runs('letters', 'id, g1, g2', 'o3', 'g1, 0, g2, 0', 'true')}),
walk AS (SELECT id, a, b, c, d, txt, cum, CAST(0 AS BIGINT) AS base, 0 AS step,
    len(list_filter(cum, lambda x: x <= {size})) AS e FROM runs
  UNION ALL
  SELECT id, a, b, c, d, txt, cum, base2, step + 1, len(list_filter(cum, lambda x: x <= base2 + {size}))
  FROM (SELECT *, CASE WHEN t <= base THEN base ELSE list_filter(cum, lambda x: x >= t)[1] END AS base2
    FROM (SELECT *, greatest(cum[e] - {overlap}, cum[e + 1] - {size}) AS t FROM walk WHERE e < len(cum)))),
cut AS (SELECT *, trim(substring(txt, base + 1, cum[e] - base)) AS chunk_text FROM walk),
chunks AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a, b, c, d, step) - 1 AS INTEGER) AS chunk_index,
  CAST(count(*) OVER (PARTITION BY id) AS INTEGER) AS total_chunks, chunk_text FROM cut WHERE chunk_text <> '')"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
