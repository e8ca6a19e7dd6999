"""Expressions behind the source cards and answers shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from complaintlens.functions.text import shorten, strip

# Colour and icon per category, and for any other.
PRODUCT_COLORS = {
    "Credit Card": "#00B4D8",
    "Personal Loan": "#F4A261",
    "Savings Account": "#56CFE1",
    "Money Transfer": "#9D4EDD",
}
PRODUCT_ICONS = {
    "Credit Card": "💳",
    "Personal Loan": "🏦",
    "Savings Account": "🏧",
    "Money Transfer": "💸",
}
OTHER_COLOR = "#0891B2"
OTHER_ICON = "📄"
UNKNOWN_PRODUCT = "Unknown"
NO_SOURCES = "_No sources retrieved._"
SNIPPET_LIMIT = 300
SNIPPET_KEEP = 297


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def product_color(product: Column) -> Column:
    return _lookup(PRODUCT_COLORS, product, OTHER_COLOR)


def product_icon(product: Column) -> Column:
    return _lookup(PRODUCT_ICONS, product, OTHER_ICON)


def text_or_document(chunk_text: Column, document: Column) -> Column:
    """First of the two that is neither null nor empty, stripped; else empty."""
    filled = F.coalesce(F.nullif(chunk_text, F.lit("")), document, F.lit(""))
    return strip(filled)


def snippet(text: Column) -> Column:
    return shorten(text, SNIPPET_LIMIT, SNIPPET_KEEP)


def two_decimals(value: Column) -> Column:
    """The double with two decimals, to the nearer one by its exact binary value, ties to even.

    This is how C and Python format; Java rounds the shortest decimal form half up. The value
    is split into a single-precision part and a rest, so that its distance from the middle
    between two hundredths has the right sign.
    """
    size = F.abs(value)
    below = F.floor(size * 100.0).cast("double")
    head = size.cast("float").cast("double")
    distance = (head * 200.0 - (below * 2.0 + 1.0)) + (size - head) * 200.0
    even = F.when(F.pmod(below, F.lit(2.0)) == 0, below).otherwise(below + 1.0)
    nearest = F.when(distance < 0, below).when(distance > 0, below + 1.0).otherwise(even)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.format_string("%.2f", sign * nearest / 100.0)


def score_label(score: Column) -> Column:
    """Two decimals; empty without a score."""
    return F.when(score.isNotNull(), two_decimals(score)).otherwise(F.lit(""))


def markdown_bold(text: Column) -> Column:
    """``**bold**`` as a ``<strong>`` element, never across a line end."""
    return F.regexp_replace(text, r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>")


def source_header(number: Column, product: Column, company: Column) -> Column:
    """``[Source 1 — product | company]``; empty parts are left out."""
    parts = F.concat_ws(
        " | ", F.nullif(product, F.lit("")), F.nullif(company, F.lit(""))
    )
    dash = F.when(parts != "", F.concat(F.lit(" — "), parts)).otherwise(F.lit(""))
    return F.concat(F.lit("[Source "), number.cast("string"), dash, F.lit("]"))


def source_card_html(
    number: Column, product: Column, company: Column, text: Column, score: Column
) -> Column:
    """One source as an HTML card. ``text`` is the cut snippet, ``product`` has its default."""
    maker = F.when(
        F.coalesce(company, F.lit("")) != "", F.concat(F.lit("<b>"), company, F.lit("</b> "))
    ).otherwise(F.lit(""))
    rated = F.when(
        score.isNotNull(), F.concat(F.lit("<i>score "), score_label(score), F.lit("</i>"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('<article><h4 style="color:'), product_color(product), F.lit('">'),
        number.cast("string"), F.lit(". "), product_icon(product), F.lit(" "), product,
        F.lit("</h4><p>"), maker, rated, F.lit("</p><blockquote>"), text, F.lit("</blockquote></article>"),
    )
