"""Repeated passages, near-duplicates, scores, decontamination and classifiers against brute force or held-out labels."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from complaintlens.llm import boosting, components, decontamination, near_duplicates, ngram_scores, quality, repeats, suffixes, toxicity


def brute_repeats(texts, window):
    starts = Counter(t[x : x + window] for t in texts for x in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for x in range(len(t) - window + 1):
            if starts[t[x : x + window]] > 1:
                gone[x : x + window] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("options", [{"ks": (5, 9, 12)}, {"ks": (5, 9, 12), "shard_bytes": 60}, {"ks": (4, 8, 12), "max_pieces": 2, "shard_bytes": 100}])
def test_repeats_equal_brute_force(spark, options):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abé"), int(n), p=[0.6, 0.3, 0.1])) for n in rng.integers(0, 90, 60)] + ["a" * 300, "ab" * 150, "a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.remove_repeats(df, window=12, **options).orderBy("doc_id").collect()
    expected = brute_repeats([t.encode() for t in texts], 12)
    assert [(r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found] == expected
    for r, text in zip(found, texts, strict=True):
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == len(text.encode()) - r.n_removed


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n = int(rng.integers(1, 300))
        raw = rng.integers(97, 98 + trial % 4, n).astype(np.uint8)
        order, rank = suffixes.suffix_array(raw, 24)
        text = raw.tobytes()
        assert sorted(order) == list(range(n))
        assert [text[i : i + 24] for i in order] == sorted(text[i : i + 24] for i in range(n))
        cuts = np.unique(np.r_[0, rng.integers(0, n, 3)])
        common = suffixes.common_prefixes(raw, order, rank, cuts, np.diff(np.r_[cuts, n]), 24)
        for before, i in zip(order[:-1], order[1:], strict=True):
            shared = 0
            while shared < 24 and max(i, before) + shared < n and text[i + shared] == text[before + shared]:
                shared += 1
            assert common[i] == shared


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, int(m)).astype(np.uint8).tobytes() for m in rng.integers(0, 300, 20)] + [b"a" * 90, b"ab" * 70]
    anchors, n = {}, 0
    for parts in suffixes.regions(texts, 20, 6):
        for text, start, count, anchor, several in zip(*parts, strict=True):
            windows = [texts[text][x : x + 20] for x in range(start, start + count)]
            assert several or len(set(windows)) == count
            n += count
            for w in windows:
                anchors.setdefault(w, set()).add(int(anchor))
    assert n == sum(max(0, len(t) - 19) for t in texts) and all(len(a) == 1 for a in anchors.values())


def brute_fingerprint(text, width=4):
    words = text.lower().split(" ") if text else []
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), seed=42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("shard_rows", [40_000, 20])
def test_near_duplicates_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    texts = []
    for i in range(150):
        part = base[i % 12].split(" ")
        for _ in range(int(rng.integers(0, 3))):
            part[int(rng.integers(0, 60))] = str(rng.choice(words))
        texts.append(" ".join(part))
    texts += ["", "one", "One", "one two"]
    df = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    found = near_duplicates.near_duplicates(df, shard_rows=shard_rows).orderBy("doc_id").collect()
    prints = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints.tolist()]
    root = list(range(len(texts)))
    changed = True
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while changed:
        new = [min(root[j] for j in np.flatnonzero(close[i])) for i in range(len(texts))]
        changed, root = new != root, new
    assert [r.component_id for r in found] == [100 + r for r in root]
    assert len(set(root)) < 100
    kept = {r.doc_id for r in near_duplicates.keep_one_of_each(df, shard_rows=shard_rows).collect()}
    assert kept == {100 + r for r in root}


def test_many_fingerprints_that_agree_in_a_part():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 2**20, 3000).astype(np.uint64) << np.uint64(40))
    a, b = near_duplicates.shard_links(prints, prints, lambda x: x & np.uint64(0xFFFF), 2, 1, leaf=16)
    links = near_duplicates.Links(len(prints))
    links.add(np.searchsorted(prints, a), np.searchsorted(prints, b))
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    i, j = np.nonzero(close)
    assert (links.parent[i] == links.parent[j]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 199: 199, 200: 199}


def test_language_model_stores_no_table_of_pairs(spark, monkeypatch):
    sizes, store = {}, ngram_scores.written_once

    def counted(df, purpose):
        out = store(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(ngram_scores, "written_once", counted)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 300)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ngram_scores.score_documents(docs).count() == 20
    n_pairs = len({p for t in texts for p in zip([None, *t.split()], t.split())})
    assert n_pairs > 2_000 and max(sizes.values()) <= 61


@pytest.mark.parametrize("options", [{}, {"hot_words": 16, "hot_pairs": 8, "grams_per_part": 500}])
def test_scores_equal_brute_force(spark, options):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, int(n)) % 300) for n in rng.integers(0, 80, 60)]
    pairs = [list(zip([None, *t.split()], t.split(), strict=False)) for t in texts]
    both, first, second = Counter(p for ps in pairs for p in ps), Counter(p[0] for ps in pairs for p in ps), Counter(p[1] for ps in pairs for p in ps)
    total = sum(both.values())
    expected = [sum(math.log(both[p] / first[p[0]]) if both[p] > 1 else math.log(0.4 * second[p[1]] / total) for p in ps) for ps in pairs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_scores.score_documents(df, **options).orderBy("doc_id").collect()
    assert [r.n_words for r in found] == [len(ps) for ps in pairs]
    assert [r.log_score for r in found] == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("options", [{}, {"hot_words": 0, "hot_pairs": 0}, {"hot_words": 12, "min_count": 1}, {"hot_words": 40, "hot_pairs": 3, "min_count": 3}])
def test_scores_of_frequent_and_rare_pairs(spark, options):
    rng = np.random.default_rng(8)
    blanks = [" ", "\t", "\n", "\x0b", "\f", "\r", "  "]
    texts = ["".join(f"É{int(x)}B" + blanks[int(x) % 7] for x in rng.zipf(1.3, 90) % 500) for _ in range(40)]
    texts += ["Of the " * 60, " of\u00a0the of", "", " \n", None, *["Rare couple"] * 2, "the end"]
    pairs = [list(zip([None, *w], w, strict=False)) for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("B", "b").replace("O", "o").replace("R", "r")) for t in texts)]
    both, first, second = Counter(p for ps in pairs for p in ps), Counter(p[0] for ps in pairs for p in ps), Counter(p[1] for ps in pairs for p in ps)
    total, least = sum(both.values()), options.get("min_count", 2)
    expected = [sum(math.log(both[p] / first[p[0]]) if both[p] >= least else math.log(0.4 * second[p[1]] / total) for p in ps) for ps in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = ngram_scores.score_documents(docs, **options).orderBy("doc_id").collect()
    assert [r.n_words for r in found] == [len(ps) for ps in pairs]
    assert [r.log_score for r in found] == pytest.approx(expected, abs=1e-4)


def test_language_model_leaves_little_on_disk(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 500) % 50_000) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk():
        found = manager.getAllFiles()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size())}

    before = on_disk()
    assert ngram_scores.score_documents(docs).agg(F.sum("log_score")).first()[0] < 0
    written = sum(n for path, n in on_disk().items() if path not in before)
    assert written < 8 * 200_000


def test_similar_windows_are_found(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(400)]
    items = [list(rng.choice(words, n)) for n in (12, 30, 57, 3)]
    other = lambda n: list(rng.choice(words, n))
    changed = [*items[1][:2], "NEW", *items[1][3:]]
    docs = {
        1: other(40) + items[0] + other(20), 2: other(10) + changed + other(9), 3: other(60), 4: [w.upper() for w in items[2]], 5: other(5) + items[3],
        6: items[1][:15] + other(40), 7: other(3) + items[2][:50] + other(30),
    }

    def grams(w, k):
        return Counter(tuple(x.lower() for x in w[i : i + k]) for i in range(len(w) - k + 1))

    expected = {}
    for d, text in docs.items():
        for i, item in enumerate(items):
            k, best = min(5, len(item)), 0.0
            for s in range(max(1, len(text) - len(item) + 1)):
                a, b = grams(text[s : s + len(item)], k), grams(item, k)
                best = max(best, (a & b).total() / max(1, (a | b).total()))
            if best >= 0.8:
                expected[d, i] = best
    frame = spark.createDataFrame([(d, ", ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_items(frame, wanted).collect()}
    assert found == pytest.approx(expected) and set(found) >= {(1, 0), (4, 2), (5, 3)}


def test_trees_learn_and_are_flat():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = boosting.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    # One row through the trees, node by node.
    margin = forest.bias
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[0, feature[node]] > threshold[node])
        margin += value[node - len(feature)]
    assert forest.margin(x[:1])[0] == pytest.approx(margin)


FOLDER = "/root/testdata/sf0.1"


def labelled(spark, column):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    return docs.join(labels.select("doc_id"), "doc_id"), labels, {r.doc_id: r[column] for r in labels.collect()}


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark, "quality")
    rows = [r for r in quality.score_quality(docs, labels).collect() if r.held_out]
    assert len(rows) > 500 and sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.98
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).select("doc_id").collect()}
    assert {r.doc_id for r in rows if r.predicted} <= kept


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark, "toxic")
    rows = [r for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out]
    hits = [r for r in rows if truth[r.doc_id]]
    assert len(rows) > 500 and sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in hits) / len(hits) > 0.75


def test_windows_cover_the_text():
    for n in range(400):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered and len(starts) == len(set(starts)) >= 1
        assert all(b - a == toxicity.STRIDE < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_gradients_of_the_network():
    from complaintlens.llm import recurrent

    rng = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in recurrent.initial(5, 3, 4, rng).items()}
    x, mask = rng.normal(size=(6, 4, 5)), (np.arange(6)[:, None] < np.array([6, 3, 1, 0])).astype(float)

    def loss():
        return recurrent.forward(p, x @ p["ahead_in"] + p["ahead_bias"], x @ p["back_in"] + p["back_bias"], mask)[0]

    logits, kept = recurrent.forward(p, x @ p["ahead_in"] + p["ahead_bias"], x @ p["back_in"] + p["back_bias"], mask)
    gradients, d_ahead, d_back = recurrent.backward(p, mask, kept, np.ones(4))
    gradients["ahead_in"] = np.einsum("tbi,tbh->ih", x, d_ahead)
    gradients["back_in"] = np.einsum("tbi,tbh->ih", x, d_back)
    for name, gradient in gradients.items():
        at = tuple(int(rng.integers(0, n)) for n in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-2
        up = loss().sum()
        p[name][at] = old - 1e-2
        down = loss().sum()
        p[name][at] = old
        assert gradient[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3), name


def test_digest_of_what_is_kept(spark):
    df = spark.createDataFrame([(1, "x" * 10)], "doc_id long, text string")
    assert hashlib.sha256(bytes(repeats.remove_repeats(df).first().kept)).hexdigest() == hashlib.sha256(b"x" * 10).hexdigest()
