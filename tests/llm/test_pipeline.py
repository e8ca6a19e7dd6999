"""Each stage of the pipeline against a plain version on the smallest tables."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from complaintlens.llm import decontamination, near_duplicates, quality, repeats

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")

    kept = corpus_pipeline.filter_quality(spark, docs, FOLDER)
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and len(good) > 100

    groups = defaultdict(list)
    prints = {i: near_duplicates.simhash(r.text, 4) for i, r in rows.items()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()}
    for i, p in prints.items():
        near = [j for j, q in prints.items() if bin(p ^ q).count("1") <= 4]
        groups[min(near)].append(i)
    assert all(min(near) in kept or any(j in kept for j in near) for near in groups.values())
    assert not any(bin(prints[a] ^ prints[b]).count("1") <= 4 for a in kept for b in kept if a < b)

    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, FOLDER).collect()}
    spans = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    for i, r in rows.items():
        raw, gone = r.text.encode(), np.zeros(len(r.text.encode()), bool)
        for s in spans[i].spans:
            gone[s.start : s.end] = True
        assert cut[i] == bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "replace")

    found = {r.doc_id for r in decontamination.find_items(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, FOLDER).collect()} == set(rows) - found and found

    mixed = corpus_pipeline.mix(spark, docs, FOLDER).collect()
    assert all(r.taken > 0 and r.text == rows[r.doc_id].text for r in mixed) and len(mixed) > 50


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 50 and {"doc_id", "text", "taken"} <= set(out.columns)
