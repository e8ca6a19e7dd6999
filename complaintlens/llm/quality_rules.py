"""Quality rules as a short-circuit cascade.

Rules are tried on a text one after the other until one rejects it. Cheap rules that reject much come first: cost
and selectivity of each rule are estimated on a small sample (the texts of smallest hash), and the rules are put in the order
of rejections per second. The verdict is that no rule rejects, so it does not depend on the order, and the estimates need not
repeat. The figures of the result columns (words, word characters, symbols, repeated lines, repeated windows) are computed for
every text anyway; what the order can save is the rest: distinct words beyond those, letter cases and exclamation marks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintlens.llm.beside import map_beside

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Facts:
    """Counts of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        # On bytes, split() knows exactly the six ASCII white-space characters.
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [line for line in self.raw.split(b"\n") if line.strip()]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def word_ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(word, len(known)) for word in self.words), np.int64, self.n_words)

    @cached_property
    def n_distinct(self) -> int:
        return int(self.word_ids.max()) + 1 if self.n_words else 0

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of ``WINDOW`` words found twice or more in the text."""
        n = self.n_words - WINDOW + 1
        if n < 2 or self.n_distinct == self.n_words:
            return 0
        ids, width = self.word_ids, 1
        while width < WINDOW:  # names of windows of 2, 4 and 8 words
            _, ids = np.unique(ids[:-width] * len(ids) + ids[width:], return_inverse=True)
            width *= 2
        again = np.bincount(ids)[ids] > 1
        edges = np.zeros(self.n_words + 1, np.int64)
        edges[:n] += again
        edges[WINDOW:] -= again
        return int((np.cumsum(edges)[:-1] > 0).sum())

    @cached_property
    def letters(self) -> tuple[int, int]:
        """ASCII capitals and ASCII small letters."""
        counts = np.bincount(np.frombuffer(self.raw, np.uint8), minlength=123)
        return int(counts[65:91].sum()), int(counts[97:123].sum())

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


# Rejected whatever else a text has.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("short_words", lambda t: 2 * t.word_chars < 3 * t.n_words),
    Rule("capitals", lambda t: t.letters[0] > t.letters[1]),
    Rule("exclamations", lambda t: 4 * t.n_marks > t.n_words),
    Rule("few_distinct_words", lambda t: 20 * t.n_distinct < t.n_words),
)


# Figures that every text needs for the result columns; a rule is charged only for what it computes beyond them.
OUTPUT_FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_outputs(text: str | None) -> Facts:
    """Facts of ``text`` with the figures of the result columns computed."""
    facts = Facts(text)
    for name in OUTPUT_FACTS:
        getattr(facts, name)
    return facts


def cascade(facts: Facts, ordered: tuple[Rule, ...]) -> tuple[bool, int]:
    """Whether no rule rejects, and how many rules were tried until one did."""
    for tried, rule in enumerate(ordered, 1):
        if rule.rejects(facts):
            return False, tried
    return True, len(ordered)


def estimate_order(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int = 200) -> tuple[Rule, ...]:
    """``rules`` by rejections per second of marginal cost, on the ``sample_rows`` texts of smallest hash.

    A rule's cost is the time it takes on facts that already hold the result columns' figures (a copy per rule, so no rule is
    charged for another's work or spared it). The sample is spread over the whole table and measured in a task; no text
    reaches the driver.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            took, hits = [0.0] * len(rules), [0] * len(rules)
            for text in batch["text"]:
                base = with_outputs(text)
                for i, rule in enumerate(rules):
                    facts = Facts(text)
                    facts.__dict__.update(base.__dict__)
                    start = time.perf_counter()
                    hits[i] += bool(rule.rejects(facts))
                    took[i] += time.perf_counter() - start
            yield pd.DataFrame({"rule": range(len(rules)), "took": took, "hits": hits})

    sample = docs.select(F.col(text_col).alias("text")).orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    rows = (
        sample.mapInPandas(measure, "rule int, took double, hits long")
        .groupBy("rule").agg((F.sum("hits") / F.greatest(F.sum("took"), F.lit(1e-9))).alias("gain"), F.sum("took").alias("took"))
        .collect()
    )
    gain = {row["rule"]: (-row["gain"], row["took"]) for row in rows}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (gain.get(i, (0.0, 0.0)), i)))


def apply_quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 200
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false if a rule of ``BASE_RULES`` or of ``rules`` rejects the text. A null text counts as empty (and so fails
    the base), a null id stays null, repeated rows give repeated results, other columns are left out, an empty table gives
    an empty result.
    """
    ordered = estimate_order(docs, text_col, rules, sample_rows)

    def judge(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        for text in batch["text"]:
            facts = with_outputs(text)
            # The base rules read only the result columns' figures, so they cost nothing more and go first.
            failed = any(rule.rejects(facts) for rule in BASE_RULES)
            kept = not failed and cascade(facts, ordered)[0]
            rows.append((facts.n_words, facts.word_chars, facts.n_symbols, facts.n_dup_lines, facts.n_repeat_words, failed, kept))
        yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_beside(rows, ["id"], judge, made).withColumnRenamed("id", id_col)
