"""License scans by diagonal voting.

The k-grams of all texts are joined by hash to the k-grams of license templates. A hit at word p of a text and word t
of a template votes for the diagonal p - t. A template that stands in a text word by word gives all its votes to one
diagonal; words put in or left out move the rest to a neighbouring one, so neighbouring diagonals are merged. Hits are
verified by comparing the words themselves, and a span counts if enough of the template's k-grams lie in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintlens.llm.words import alphanumeric_words, explode_grams, gram_hash

K = 3
# Phrases that stand for a license by themselves, and the label of each.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening words of well-known license notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "this work is licensed under a creative commons attribution sharealike license": "cc-by-sa",
}


def template_grams(spark: SparkSession, templates: dict[str, str], exact: bool, first_id: int) -> list[tuple]:
    """A row per k-gram: template id, label, exact, number of k-grams, number of words, place t, the k words."""
    rows = []
    for i, (text, label) in enumerate(templates.items(), first_id):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"template of fewer than {K} words: {text}")
        grams = len(words) - K + 1
        rows += [(i, label, exact, grams, len(words), t, *words[t : t + K]) for t in range(grams)]
    return rows


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
    coverage: float = 0.8, max_shift: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places where the words of a phrase stand consecutively, ``first_word`` and ``last_word`` are the
    smallest and largest start of those (null if none). ``labels`` also has the labels of notices of whose k-grams at least
    ``coverage`` lie on diagonals at most ``max_shift`` apart, in a band whose first and last diagonal differ by at most
    max(``max_shift``, floor((1 - ``coverage``) * template words)); a wider band is scattered k-grams and has share 0. ``score`` is the largest share found of any template.
    ``spans`` lists (label, first word, last word, share), in order. Null and blank texts have no words. Rows that repeat
    an id and text give repeated results, also if the id is null. Other columns are left out; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), alphanumeric_words(F.col(text_col)).alias("words"))
    # An empty word stands before each text: it matches nothing, and its row brings the text through to the result.
    words = words.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), "words").alias("words"))
    grams = explode_grams(words, "words", K, "id", "text_hash", "n_words").withColumn("hash", gram_hash(F.col("gram"), K))

    # The templates are parameters, a few hundred k-grams: a broadcast of fixed size.
    rows = template_grams(spark, phrases, True, 0) + template_grams(spark, notices, False, len(phrases))
    columns = "tpl int, label string, exact boolean, grams int, length int, t int, " + ", ".join(f"w{j} string" for j in range(K))
    templates = spark.createDataFrame(rows, columns).withColumn("thash", F.xxhash64(*[f"w{j}" for j in range(K)]))
    same = (F.col("hash") == F.col("thash")) & F.expr(" AND ".join(f"gram.w{j} = w{j}" for j in range(K)))
    hits = grams.join(F.broadcast(templates), same, "left").filter((F.col("pos") == 0) | F.col("tpl").isNotNull())
    return _summarise(hits, id_col, coverage, max_shift)


def _joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))), ",")


def _summarise(hits: DataFrame, id_col: str, coverage: float, max_shift: int) -> DataFrame:
    text, template = ["id", "text_hash", "n_words"], ["tpl", "label", "exact", "grams", "length"]
    # Votes of each diagonal. Rows that repeat a text vote for the same places, which count once; the row without a
    # template tells how many there are.
    diagonals = hits.groupBy(*text, *template, (F.col("pos") - 1 - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.count("*").alias("copies"))
    along = Window.partitionBy(*text, "tpl").orderBy("diagonal")
    before = F.lag("diagonal").over(along)
    apart = F.col("exact") | before.isNull() | (F.col("diagonal") - before > max_shift)
    bands = diagonals.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(along))
    spans = bands.groupBy(*text, *template, "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("votes"), F.min("diagonal").alias("start"), F.max("diagonal").alias("stop"), F.max("copies").alias("copies")
    )
    spans = spans.withColumn("share", F.col("votes") / F.col("grams"))
    # Verification: a band may drift by inserted or left-out words, at most a (1 - coverage) share of the template (and
    # ``max_shift``); k-grams scattered over a longer stretch are no copy of it, and their band counts for nothing.
    drift = F.greatest(F.lit(max_shift).cast("double"), F.floor(F.col("length") * (1 - coverage) + 1e-9))
    spans = spans.withColumn("share", F.when(F.col("exact") | (F.col("stop") - F.col("start") <= drift), F.col("share")).otherwise(F.lit(0.0)))
    base = F.col("exact") & (F.col("share") == 1)
    found = base | (~F.col("exact") & (F.col("share") >= coverage))
    span = F.struct("label", F.col("start").cast("long").alias("first_word"), (F.col("stop") + F.col("length") - 1).cast("long").alias("last_word"), "share")
    return (
        spans.groupBy(*text)
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            _joined_labels(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            _joined_labels(F.collect_set(F.when(found, F.col("label")))).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
            F.max(F.when(F.col("tpl").isNull(), F.col("copies"))).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )


def normalise_phrase(text: str) -> str:
    """``text`` in the form of a template: its words, lower-cased, one blank apart."""
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
