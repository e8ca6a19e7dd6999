"""License scans, chat formatting, mixing and quality rules against plain versions."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from complaintlens.llm import chat, licenses, mixing, quality_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_places_and_labels(spark):
    notice = next(iter(licenses.NOTICES))
    words = notice.split()
    texts = [
        "Released under the MIT License. Under the mit-license!", "licensed under the Apache License, Version 2.0 or CC BY-NC", "under the mit", notice.upper(),
        " ".join(words[:8] + ["inserted"] + words[8:]), " ".join(words[:6]), "Under the MİT license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows] == [
        (2, 1, 5, "mit", "mit"), (2, 3, 9, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (0, None, None, "", ""),
        (0, None, None, "", "mit"), (0, None, None, "", "mit"), (0, None, None, "", ""), (0, None, None, "", ""),
    ]
    assert rows[0].score == 1.0 and rows[0].n_words == 9 and 0.8 <= rows[4].score < 1.0 and 0 < rows[5].score < 0.8
    assert [(s.label, s.first_word) for s in rows[4].spans] == [("mit", 0)]
    # Every place of the phrases, found by looking at each word.
    for text, row in zip(texts, rows, strict=True):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places = [i for phrase in licenses.PHRASES for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base) == (len(found), len(places))


PIECES = st.sampled_from(["<|", "|>", "<|end|>\n", "<|turn|>", "<|chat|>0", "\\", "\\s", "\\n", "<\\p", "\n", "a", "é😀", "</s>[INST]"])
TEXTS = st.lists(PIECES, max_size=6).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=4), min_size=1, max_size=12))
def test_chats_come_back(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert len(texts) == len(conversations)
    found = chat.read_turns(spark.createDataFrame(list(texts.items()), "conv_id long, formatted string"), loss_role="a").collect()
    assert sorted((r.conv_id, r.i, r.role, r.text) for r in found) == rows
    for r in found:
        inside = texts[r.conv_id][r.start - 1 : r.start - 1 + r.length]
        level = int(texts[r.conv_id][len(chat.HEADER)])
        plain = inside.replace("\\n", "\n").replace("\\p", "|").replace("\\s", "\\") if level else inside
        assert plain == r.text and r.in_loss == (r.role == "a") and chat.OPENER not in inside


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, "w " * (i % 37), f"s{0 if i % 3 == 0 else i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix_sources(df.coalesce(1)).collect()))
    taken, sizes, targets = Counter(), Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for source, target in targets.items():
        assert target <= 3 * sizes[source] and 0 <= target - taken[source] <= 37
    # Shares by weight, the excess over three times a source's size given to the others.
    open_ = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    expected, rest = {}, float(sum(sizes.values()))
    while open_:
        unit = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > 3 * sizes[s]]
        for s in full or list(open_):
            expected[s] = 3.0 * sizes[s] if full else open_[s] * unit
        rest -= sum(expected[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in expected}
    assert targets == pytest.approx(expected)


def test_mix_with_equal_hashes_and_a_single_document(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 50 + [(2, "d", "y")], "doc_id long, text string, source string")
    found = mixing.mix_sources(df).collect()
    assert len({r.taken for r in found if r.source == "x"}) == 1 and all(r.taken <= 3 * r.size for r in found)


def test_rule_counts(spark):
    facts = quality_rules.Facts("a b\na b\n\n \na b c # $x\t é\x0b")
    assert (facts.n_words, facts.word_chars, facts.n_symbols, facts.n_lines, facts.n_dup_lines) == (10, 11, 2, 3, 1)
    words = "q w e r t y u i o p q w e r t y u i z".split()
    n, w = len(words), quality_rules.WINDOW
    grams = Counter(tuple(words[i : i + w]) for i in range(n - w + 1))
    covered = {j for i in range(n - w + 1) if grams[tuple(words[i : i + w])] > 1 for j in range(i, i + w)}
    assert quality_rules.Facts(" ".join(words)).n_repeat_words == len(covered) == 16
    assert quality_rules.Facts("a " * 30).n_repeat_words == 30


def test_the_order_of_the_cascade_does_not_change_verdicts(spark):
    texts = ["plain words that say nothing new at all but go on and on for long enough to pass every rule here", "A B!! " * 40, "x " * 60, "### word " * 30, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.kept for r in quality_rules.apply_quality_rules(df).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False, False]
    backwards = quality_rules.apply_quality_rules(df, rules=quality_rules.RULES[::-1], sample_rows=1).orderBy("doc_id").collect()
    assert [r.kept for r in backwards] == kept
    order = quality_rules.estimate_order(df, "text", quality_rules.RULES)
    assert {r.name for r in order} == {r.name for r in quality_rules.RULES}


def test_mix_reaches_targets_with_a_third_of_ids_null_or_repeated(spark):
    """Rows without an id, or sharing one, are told apart by their texts, so every source comes near its target."""
    import random

    rng = random.Random(9)
    rows = []
    for i in range(3000):
        doc_id = None if i % 3 == 0 else (i if i % 3 == 1 else 7)
        rows.append((doc_id, " ".join("w" for _ in range(rng.randrange(1, 40))) + f" t{i}", f"s{i % 3}"))
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("s0", "s1", "s2"):
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 * max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size for r in mine)


def test_scattered_trigrams_of_a_notice_are_no_license(spark):
    """Each trigram of a notice followed by a foreign word: the diagonals drift 3 a step; no label. Two words put in: found."""
    from complaintlens.llm import licenses

    notice = next(t for t, label in licenses.NOTICES.items() if label == "mit").split()
    scattered = " ".join(" ".join(notice[t : t + 3]) + " zz" for t in range(len(notice) - 2))
    inserted = " ".join(notice[:6] + ["really", "truly"] + notice[6:])
    docs = spark.createDataFrame([(1, scattered), (2, inserted), (3, " ".join(notice))], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[1].labels == "" and found[1].score < 0.8
    assert found[2].labels == "mit" and found[3].labels == "mit" and found[3].score == 1.0


def test_the_estimated_order_tries_fewer_rules(spark):
    """On texts that one rule rejects, the estimated order tries fewer rules than the reverse of it."""
    plain = "plain words that say nothing new at all but go on and on for long enough to pass every rule here"
    texts = [("!! " + plain + " ") * 2 + "!! " * 20 for _ in range(30)] + [plain] * 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ordered = quality_rules.estimate_order(df, "text", quality_rules.RULES)
    assert ordered[0].name == "exclamations"
    tried = lambda order: sum(quality_rules.cascade(quality_rules.with_outputs(t), order)[1] for t in texts)
    assert tried(ordered) < tried(ordered[::-1])
    assert [quality_rules.cascade(quality_rules.with_outputs(t), ordered)[0] for t in texts] == [
        quality_rules.cascade(quality_rules.with_outputs(t), ordered[::-1])[0] for t in texts
    ]
