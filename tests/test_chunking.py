import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from complaintlens.functions.batches import text_slices
from complaintlens.operators import embedding
from complaintlens.operators.chunking import chunk_documents, chunk_stats, split_text, splitter


def reference_split(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """The published algorithm, written the long way."""
    for at, separator in enumerate(separators):
        if separator == "" or separator in text:
            break
    finer = separators[at + 1 :]
    if separator == "":
        pieces = list(text)
    else:
        parts = re.split(f"({re.escape(separator)})", text)
        pieces = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts), 2)]
    pieces = [p for p in pieces if p]

    def merged(run):
        out, window, total = [], [], 0
        for piece in run:
            if total + len(piece) > size and window:
                out.append("".join(window).strip())
                while window and (total > overlap or total + len(piece) > size):
                    total -= len(window.pop(0))
            window.append(piece)
            total += len(piece)
        out.append("".join(window).strip())
        return [o for o in out if o]

    out, run = [], []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            if run:
                out += merged(run)
                run = []
            out += reference_split(piece, size, overlap, finer) if finer else [piece]
    return out + (merged(run) if run else [])


def test_known_splits():
    chunks = split_text("word " * 100, 50, 10)
    assert len(chunks) == 13 and max(map(len, chunks)) == 49
    assert [len(c) for c in split_text("x" * 25, 10, 3)] == [10, 10, 10, 4]
    short = "This is a short complaint narrative."
    assert split_text(short, 500, 50) == [short]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.sampled_from(list("ab. \n")), max_size=300),
    st.integers(5, 60),
    st.integers(0, 4),
)
def test_split_equals_brute_force(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert chunks == reference_split(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400), st.integers(5, 60))
def test_without_overlap_nothing_is_lost(text, size):
    assert "".join("".join(split_text(text, size, 0)).split()) == "".join(text.split())


def test_chunk_table(spark):
    df = spark.createDataFrame(
        [(1, "short text", "Credit Card"), (2, "word " * 200, "Personal Loan")],
        "complaint_id long, narrative string, product_category string",
    )
    rows = chunk_documents(df, "narrative", "complaint_id", ["product_category"], 100, 20).collect()
    assert [r.chunk_text for r in rows if r.complaint_id == 1] == ["short text"]
    long = [r for r in rows if r.complaint_id == 2]
    assert len(long) > 1 and {r.product_category for r in long} == {"Personal Loan"}
    assert [r.chunk_index for r in long] == list(range(len(long)))
    assert {r.total_chunks for r in long} == {len(long)}
    assert [r.chunk_id for r in long] == [f"2_{i}" for i in range(len(long))]


def test_blank_texts_have_no_chunks(spark):
    df = spark.createDataFrame(
        [(1, "valid text here"), (2, ""), (3, None), (4, " \n ")], "complaint_id long, narrative string"
    )
    chunks = chunk_documents(df, "narrative", "complaint_id")
    assert [r.complaint_id for r in chunks.collect()] == [1]
    stats = chunk_stats(chunks, df).first()
    assert (stats.n_chunks, stats.n_complaints, stats.chunks_per_complaint) == (1, 4, 0.25)


def test_chunking_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert "Exchange" not in chunk_documents(df, "t", "id")._jdf.queryExecution().executedPlan().toString()


def test_wrong_sizes_are_refused():
    with pytest.raises(ValueError):
        splitter(10, 10)
    with pytest.raises(ValueError):
        splitter(0, 0)


def test_text_slices_stay_small_and_whole():
    texts = pa.array(["a" * 40, None, "", "b" * 70, "c" * 300, None, "d"])
    slices = list(text_slices(texts, 100))
    assert [len(x) for x in slices] == [3, 1, 3] and pa.concat_arrays(slices).equals(texts)
    assert list(text_slices(pa.array([], pa.string()), 100)) == []


def test_each_text_is_cut_once(spark):
    rows = [(1, "word " * 300), (2, " "), (3, None), (4, "short one")]
    chunks = chunk_documents(spark.createDataFrame(rows, "k long, t string"), "t", "k")
    assert chunks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = {(r.complaint_id, r.chunk_index, r.total_chunks): r.chunk_text for r in chunks.collect()}
    wanted = split_text(rows[0][1])
    assert found == {(1, i, len(wanted)): c for i, c in enumerate(wanted)} | {(4, 0, 1): "short one"}


def test_large_texts_are_cut_and_embedded_in_small_parts(spark):
    rows = [(i, f"word{i} and fee. " * 20_000) for i in range(6)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    vectors = embedding.embed(chunk_documents(df, "t", "k"), "chunk_text", embedding.hashed(16))
    assert vectors._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    found = {(r.complaint_id, r.chunk_index): r.embedding for r in vectors.collect()}
    pieces = {(k, i): c for k, t in rows for i, c in enumerate(split_text(t))}
    assert found.keys() == pieces.keys()
    plain = embedding.HashedEmbedder(16).embed([pieces[at] for at in found]).astype("float32")
    assert np.allclose(np.array(list(found.values())), plain)
