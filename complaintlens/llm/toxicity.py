"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words.

The input of a word is the vector of the word, if it is common in the training texts, and the mean of the vectors of its
character n-grams. Windows of ``WINDOW`` words start every ``STRIDE`` words, so neighbours overlap. A
text is as toxic as its worst window. A label belongs to the text, not to a window: training takes, of each toxic text,
the window that scores highest so far, and of each clean text its highest and some others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complaintlens.llm import recurrent
from complaintlens.llm.beside import map_beside
from complaintlens.llm.labelled import remainder, training_ids

WINDOW, STRIDE = 64, 48
BUCKET_BITS = 14
BUCKETS, WORD_WIDTH, CHAR_WIDTH, HIDDEN, ATTENTION = 1 << BUCKET_BITS, 8, 8, 8, 8
SIZES = range(3, 7)  # character n-grams
LONGEST = 40  # characters of a word whose n-grams are taken at once; longer words are cut into pieces
MAX_CACHED = 200_000
SCORED_AT_ONCE = 4096
FIND_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words of the whole text, lower-cased; runs of over ``LONGEST`` characters are several words."""
    found = FIND_WORDS.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of ``words``, word after word, and how many each has (one at least)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the end of the word
    buckets, valid = np.zeros((len(codes), len(SIZES)), np.int64), np.zeros((len(codes), len(SIZES)), bool)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        rolled = rolled * np.uint64(1_000_003) + np.concatenate([codes[n - 1 :], np.zeros(min(n - 1, len(codes)), np.uint64)])
        if n in SIZES:
            j = n - SIZES[0]
            buckets[:, j] = ((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
            valid[:, j] = left >= n
    return buckets[valid], np.add.reduceat(valid.sum(axis=1), np.cumsum(lengths) - lengths) if len(words) else lengths


def window_starts(n: int) -> list[int]:
    """Starts of the windows of a text of ``n`` words; a text without words has one window, all padding."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE))


class Model:
    """Vocabulary and parameters. Travels to the tasks; the cache of projected words stays there."""

    def __init__(self, vocabulary: dict[str, int], parameters: recurrent.Parameters) -> None:
        self.vocabulary, self.p = vocabulary, parameters
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = [np.zeros((1, 6 * HIDDEN), np.float32)]

    def inputs(self, words: list[str]) -> np.ndarray:
        flat, counts = ngram_buckets(words)
        chars = np.add.reduceat(self.p["chars"][flat], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        return np.concatenate([self.p["words"][[self.vocabulary.get(w, 0) for w in words]], chars], axis=1).astype(np.float32)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        p = self.p
        return np.concatenate([inputs @ p["ahead_in"] + p["ahead_bias"], inputs @ p["back_in"] + p["back_bias"]], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Per text the largest probability over its windows."""
        if len(self.known) > MAX_CACHED:
            self._clear()
        known, fresh, all_ids = self.known, [], []
        for text in texts:
            ids = []
            for word in words_of(text):
                i = known.get(word)
                if i is None:
                    i = known[word] = len(known) + 1
                    fresh.append(word)
                ids.append(i)
            all_ids.append(np.array(ids, np.int64))
        for at in range(0, len(fresh), SCORED_AT_ONCE):
            self.rows.append(self.project(self.inputs(fresh[at : at + SCORED_AT_ONCE])))
        table = np.concatenate(self.rows) if len(self.rows) > 1 else self.rows[0]
        self.rows = [table]
        starts = [window_starts(len(ids)) for ids in all_ids]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        padded = [np.concatenate([ids, np.zeros(WINDOW, np.int64)]) for ids in all_ids]
        offsets = np.cumsum([0, *map(len, padded)])[:-1]
        stream = np.concatenate(padded) if padded else np.zeros(0, np.int64)
        at = np.array([s for part in starts for s in part], np.int64) + offsets[owner]
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(at), SCORED_AT_ONCE):
            ids = stream[at[a : a + SCORED_AT_ONCE][None, :] + np.arange(WINDOW)[:, None]]
            projected, mask = table[ids], (ids > 0).astype(np.float32)
            logits, _ = recurrent.forward(self.p, projected[:, :, : 3 * HIDDEN], projected[:, :, 3 * HIDDEN :], mask)
            np.maximum.at(best, owner[a : a + SCORED_AT_ONCE], logits)
        return recurrent.sigmoid(best)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 8, steps: int = 400, rate: float = 0.01, batch: int = 64, max_words: int = 4000, seed: int = 1) -> Model:
    """A model of ``texts`` and their 0/1 ``labels``, trained for ``epochs`` and at least ``steps`` batches.

    With labels of one class or none it scores all texts alike.
    """
    rng, tokens = np.random.default_rng(seed), [words_of(t) for t in texts]
    frequent = Counter(w for part in tokens for w in set(part))
    common = sorted((w for w, n in frequent.items() if n > 2), key=lambda w: (-frequent[w], w))[:max_words]
    vocabulary = {w: i for i, w in enumerate(common, 1)}
    p = recurrent.initial(WORD_WIDTH + CHAR_WIDTH, HIDDEN, ATTENTION, rng)
    p |= {"words": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_WIDTH)).astype(np.float32), "chars": rng.normal(0, 0.1, (BUCKETS, CHAR_WIDTH)).astype(np.float32)}
    model = Model(vocabulary, p)
    if len(set(labels.tolist())) < 2:
        p["out"][:] = 0
        p["out_bias"][:] = 8 * (labels.mean() - 0.5) if len(labels) else 0
        return model

    names = sorted(frequent)
    number = {w: i + 1 for i, w in enumerate(names)}
    flat, counts = ngram_buckets([" ", *names])  # number 0 is padding
    bounds = np.cumsum(counts) - counts
    word_ids = np.array([0, *(vocabulary.get(w, 0) for w in names)])
    windows, owner = [], []
    for i, part in enumerate(tokens):
        ids = np.array([number[w] for w in part] + [0] * WINDOW)
        for s in window_starts(len(part)):
            windows.append(ids[s : s + WINDOW])
            owner.append(i)
    windows, owner = np.array(windows), np.array(owner)

    # Log odds of a bucket between toxic and clean texts: a start for one place of the character vectors and for the
    # choice of windows.
    seen = np.zeros((2, BUCKETS))
    for part, label in zip(tokens, labels, strict=True):
        buckets = np.unique(np.concatenate([flat[bounds[i] : bounds[i] + counts[i]] for i in {number[w] for w in part}])) if part else []
        seen[int(label), buckets] += 1
    odds = np.log((seen[1] + 2) / (labels.sum() + 4)) - np.log((seen[0] + 2) / ((1 - labels).sum() + 4))
    p["chars"][:, 0] = 0.5 * odds
    odds_of_word = np.add.reduceat(odds[flat], bounds) / counts
    odds_of_word[0] = -9.0
    logits = odds_of_word[windows].max(axis=1)

    adam, label_of = recurrent.Adam(p, rate), labels[owner]
    for epoch in range(max(epochs, -(-steps * batch // max(1, 2 * len(texts))))):
        if epoch:
            logits = _logits(model, windows, word_ids, flat, bounds, counts)
        worst = np.lexsort((-logits, owner))
        worst = worst[np.r_[True, owner[worst][1:] != owner[worst][:-1]]]
        clean = np.flatnonzero(label_of == 0)
        chosen = np.concatenate([worst, rng.choice(clean, min(len(clean), len(worst)), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            _learn(model, adam, windows[part].T, label_of[part], word_ids, flat, bounds, counts)
    model._clear()
    return model


def _inputs(p: recurrent.Parameters, ids: np.ndarray, word_ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input vectors of distinct training words, the buckets of their n-grams and whose they are."""
    n = counts[ids]
    of = np.repeat(np.arange(len(ids)), n)
    buckets = flat[np.repeat(bounds[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    chars = np.add.reduceat(p["chars"][buckets], np.cumsum(n) - n, axis=0) / n[:, None]
    return np.concatenate([p["words"][word_ids[ids]], chars], axis=1).astype(np.float32), buckets, of


def _logits(model: Model, windows: np.ndarray, *tables: np.ndarray) -> np.ndarray:
    ids = np.arange(len(tables[3]))
    projected = model.project(_inputs(model.p, ids, *tables)[0])
    out = []
    for at in range(0, len(windows), SCORED_AT_ONCE):
        part = windows[at : at + SCORED_AT_ONCE].T
        x = projected[part]
        out.append(recurrent.forward(model.p, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], (part > 0).astype(np.float32))[0])
    return np.concatenate(out)


def _learn(model: Model, adam: recurrent.Adam, window: np.ndarray, labels: np.ndarray, word_ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> None:
    p, mask = model.p, (window > 0).astype(np.float32)
    ids, place = np.unique(window, return_inverse=True)
    place = place.reshape(window.shape)
    x, buckets, of = _inputs(p, ids, word_ids, flat, bounds, counts)
    projected = model.project(x)[place]
    logits, kept = recurrent.forward(p, projected[:, :, : 3 * HIDDEN], projected[:, :, 3 * HIDDEN :], mask)
    d_logit = ((recurrent.sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    gradients, d_ahead, d_back = recurrent.backward(p, mask, kept, d_logit)
    d_projected = np.zeros((len(ids), 6 * HIDDEN), np.float32)
    np.add.at(d_projected, place.ravel(), np.concatenate([d_ahead, d_back], axis=2).reshape(-1, 6 * HIDDEN))
    for side, d in (("ahead", d_projected[:, : 3 * HIDDEN]), ("back", d_projected[:, 3 * HIDDEN :])):
        gradients[f"{side}_in"], gradients[f"{side}_bias"] = x.T @ d, d.sum(axis=0)
    dx = d_projected[:, : 3 * HIDDEN] @ p["ahead_in"].T + d_projected[:, 3 * HIDDEN :] @ p["back_in"].T
    gradients["words"], gradients["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(gradients["words"], word_ids[ids], dx[:, :WORD_WIDTH])
    np.add.at(gradients["chars"], buckets, (dx[:, WORD_WIDTH:] / counts[ids][:, None])[of])
    adam.update(p, gradients)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int, max_per_class: int, max_chars: int) -> Model:
    """A network trained on at most ``max_per_class`` labelled documents of each class outside the held-out fold.

    Of each class the documents are taken in the order of their id's hash while their characters add up to at most
    ``max_chars``, which bounds what the driver holds; the first document of a class is always taken, however long. No text is
    left out for its length alone, and a text is trained on whole (all its windows).
    """
    ids = training_ids(labels, id_col, label_col, folds, held_out, max_per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most 2 * max_per_class rows from here on.
    chosen = rows.join(F.broadcast(ids), "id").withColumn("order", F.xxhash64("id"))
    before = Window.partitionBy("label").orderBy("order", "id", "text").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("before", F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0))).over(before), F.lit(0)))
    chosen = chosen.withColumn("first", F.row_number().over(Window.partitionBy("label").orderBy("order", "id", "text")) == 1)
    kept = chosen.filter(F.col("first") | (F.col("before") + F.coalesce(F.length("text"), F.lit(0)) <= max_chars))
    found = kept.orderBy("order", "id", "text").limit(2 * max_per_class).select("label", "text").toArrow()
    return train(found["text"].to_pylist(), np.array(found["label"].to_pylist(), dtype=float))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0,
    max_per_class: int = 1500, max_chars: int = 12_000_000, threshold: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, score (0 to 1, higher if label 1 is likelier), predicted.

    The network learns from rows of ``labels`` (``id_col``, ``label_col``) outside the fold that is held out, at most
    ``max_per_class`` of each class and ``max_chars`` characters a class (see ``fit_toxicity``); scores use all windows of whole texts. Null,
    empty and blank texts are one window without words. Repeated rows give repeated results, other columns are left out, an
    empty table gives an empty result; with labels of one class or none all scores are the same.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, folds, held_out, max_per_class, max_chars)

    def judge(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # Few texts at a time, so that memory depends on the longest text rather than on the batch.
        for a in range(0, len(batch), 256):
            score = model.score(batch["text"].iloc[a : a + 256].tolist())
            yield pd.DataFrame({"score": score.astype(float), "predicted": (score >= threshold).astype("int32")})

    rows = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return map_beside(rows, ["id", "held_out"], judge, "score double, predicted int").withColumnRenamed("id", id_col)
