"""Text expressions: white space, word counts, cleaning, category mapping, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip and str.split take as white space, once as
# a set of characters and once as the inside of a regular-expression class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The four target categories and the label keywords that select them.
PRODUCT_KEYWORDS = {
    "Credit Card": ["credit card"],
    "Personal Loan": ["payday loan", "personal loan", "title loan", "consumer loan"],
    "Savings Account": ["checking or savings account", "savings account", "bank account or service"],
    "Money Transfer": ["money transfer", "virtual currency", "money service"],
}
PRODUCTS = list(PRODUCT_KEYWORDS)

# Boilerplate phrases and the redaction mark, applied to lower-case text.
BOILERPLATE_PATTERNS = [
    r"i\s+am\s+writing\s+to\s+file\s+a\s+complaint[^.]*\.",
    r"i\s+am\s+writing\s+to\s+(?:file|lodge)\s+(?:this|a)\s+complaint[^.]*\.",
    r"this\s+is\s+(?:a\s+)?complaint\s+(?:against|regarding)[^.]*\.",
    r"to\s+whom\s+it\s+may\s+concern[,:]?",
    r"i\s+would\s+like\s+to\s+file\s+a\s+complaint[^.]*\.",
]
REDACTION_PATTERN = r"x{2,}(?:/x{2,}){0,2}"
KEPT_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789.,!?'"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes off blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True if not null and not blank; never null."""
    return F.coalesce(text.rlike(f"[^{WHITESPACE_CLASS}]"), F.lit(False))


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens; 0 for blank text, null for null.

    All white space becomes blanks, and the split is at a literal blank: several times faster
    than matching words with a regular expression.
    """
    return clean_word_count(F.translate(text, WHITESPACE, " " * len(WHITESPACE)))


def clean_word_count(cleaned: Column) -> Column:
    """``word_count`` for text with no white space but blanks, as ``clean_narrative`` gives it."""
    return F.array_size(F.array_remove(F.split(cleaned, " "), ""))


def clean_narrative(text: Column) -> Column:
    """Lower case, boilerplate and redaction marks out, other characters and white space to one blank.

    Characters outside the kept set and white space are replaced in one pass: a run of
    either, in any mix, ends as a single blank. The kept characters are listed one by one,
    which the expression engine turns into a table look-up. The boilerplate expression is tried
    only on texts with one of the two words that every phrase contains.
    """
    return clean_lowered(F.lower(text))


def clean_lowered(low: Column) -> Column:
    """``clean_narrative`` for text already in lower case.

    All white space becomes blanks first, since the expressions know that of ASCII only.
    """
    low = F.translate(low, WHITESPACE, " " * len(WHITESPACE))
    may_match = low.contains("complaint") | low.contains("concern")
    plain = F.when(
        may_match, F.regexp_replace(low, "|".join(BOILERPLATE_PATTERNS), " ")
    ).otherwise(low)
    unmasked = F.regexp_replace(plain, REDACTION_PATTERN, " ")
    return F.trim(F.regexp_replace(unmasked, f"[^{KEPT_CHARACTERS}]+", " "))


def map_product(label: Column, keywords: Mapping[str, Sequence[str]] = PRODUCT_KEYWORDS) -> Column:
    """First category, in the order of ``keywords``, one of whose keywords the label contains; else null."""
    low = F.lower(label)
    chain = F
    for category, words in keywords.items():
        hit = reduce(lambda a, b: a | b, [low.contains(word) for word in words])
        chain = chain.when(hit, F.lit(category))
    return chain.otherwise(F.lit(None).cast("string"))


def shorten(text: Column, limit: int, keep: int | None = None) -> Column:
    """Text over ``limit`` characters cut to ``keep`` (default ``limit``) plus three dots."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, keep or limit), F.lit("..."))
    ).otherwise(text)


def truncate(text: Column, limit: int = 160) -> Column:
    """On one line, stripped, and cut at ``limit`` with no white space before the dots."""
    line = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.rtrim(F.substring(line, 1, limit), F.lit(WHITESPACE))
    return F.when(F.length(line) > limit, F.concat(cut, F.lit("..."))).otherwise(line)


def issue_label(issue: Column, limit: int = 30) -> Column:
    """Axis label of an issue."""
    return shorten(issue, limit)


def round_even(value: Column, digits: int = 0) -> Column:
    """Rounding to the even neighbour on a tie, on doubles (``round`` goes away from zero)."""
    if digits == 0:
        return F.rint(value)
    factor = F.lit(float(10**digits))
    return F.rint(value * factor) / factor
