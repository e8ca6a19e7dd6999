"""Words and word k-grams as built-in expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
# Whatever is neither digit, lower-case ASCII letter nor outside ASCII, for texts that were lower-cased.
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and no other character changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def space_words(text: Column) -> Column:
    """The words between white space; an empty array for null and for blank texts."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def alphanumeric_words(text: Column) -> Column:
    """Runs of digits, letters and characters outside ASCII, ASCII letters lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALPHANUMERIC), "")


def explode_grams(df: DataFrame, words: str, k: int, *keep: str) -> DataFrame:
    """A row per word position: ``keep``, ``pos`` (from 0) and the struct ``gram`` (w0, w1, ...) of the ``k`` words there.

    At the last ``k - 1`` positions the missing words are null, so a text of n words gives n rows.
    """
    columns = [F.col(words).alias("w0")]
    columns += [F.slice(words, j + 1, F.greatest(F.size(words) - j, F.lit(0))).alias(f"w{j}") for j in range(1, k)]
    return df.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("pos", "gram"))


def gram_hash(gram: Column, k: int) -> Column:
    return F.xxhash64(*[gram[f"w{j}"] for j in range(k)])
