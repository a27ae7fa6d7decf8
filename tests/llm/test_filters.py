"""Filters of the pipeline: the network's definition, repeated ids, parallel archives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import quality, simhash, storage, toxicity, warc
from siftline.llm.storage import importable, shared_root

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, stats string, key_id int, held_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 9, "x", 4, "h") for i, t in rows], DOCS).repartition(3)


def score_by_definition(net, words):
    """One word and one window at a time."""
    width = 3 * toxicity.HIDDEN
    rows = list(net.gates(net.word_vectors(toxicity.features_of(words)))[1:].astype(float)) if words else [np.zeros(2 * width)]
    pad, n, h = np.zeros(2 * width), len(rows), toxicity.HIDDEN

    def read(block, d):
        state, states = np.zeros(h), []
        for row in block:
            x, g = row[d * width : (d + 1) * width] + net.bias[d, :, 0], net.recurrent[d].astype(float) @ state
            r, z = 1 / (1 + np.exp(-(x[:h] + g[:h]))), 1 / (1 + np.exp(-(x[h : 2 * h] + g[h : 2 * h])))
            new = np.tanh(x[2 * h :] + r * g[2 * h :])
            state = new + z * (state - new)
            states.append(state)
        return states

    starts = [0]
    while starts[-1] + toxicity.WINDOW < n:
        starts.append(starts[-1] + toxicity.STRIDE)
    forward, backward = [None] * n, [None] * n
    for k, s in enumerate(starts):
        block = [rows[t] if t < n else pad for t in range(s, s + toxicity.WINDOW)]
        right, left = read(block, 0), read(block[::-1], 1)[::-1]
        for j in range(min(toxicity.WINDOW, n - s)):
            if k == 0 or j >= toxicity.WINDOW - toxicity.STRIDE:
                forward[s + j] = right[j]
            if s == starts[-1] or j < toxicity.STRIDE:
                backward[s + j] = left[j]
    both = [np.concatenate(p) for p in zip(forward, backward)]
    energy, output = [np.exp([net.attention.ravel() @ p for p in both]), np.array([net.output.ravel() @ p + net.offset[0] for p in both])]
    logits = [np.average(output[s : s + toxicity.WINDOW], weights=energy[s : s + toxicity.WINDOW]) for s in range(max(n - toxicity.WINDOW, 0) + 1)]
    return net.probability(np.array([max(logits)]))[0]


def test_scores_of_all_windows_equal_the_definition():
    net = toxicity.Network.fresh(np.random.default_rng(3))
    sizes = [0, 1, 31, 32, 33, 55, 56, 57, 80, 0, 300]
    texts = [" ".join(f"w{(i * i + n) % 97}" for i in range(n)) for n in sizes]
    want = [score_by_definition(net, toxicity.words_of(t)) for t in texts]
    assert np.abs(toxicity.Scorer(net)(texts) - want).max() < 1e-6
    assert np.abs(toxicity.Scorer(net)(texts[::-1]) - want[::-1]).max() < 1e-6


def test_sample_is_bounded_by_ids_and_letters(spark, monkeypatch):
    """A sampled id brings one text, and of a long one so many pieces."""
    importable(spark)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 10)
    monkeypatch.setattr(toxicity, "PIECES", 3)
    rows = [(i, "nice words") for i in range(40)] * 3 + [(100 + i, "bad " * 5000) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, found, share: seen.extend(texts) or toxicity.Network.fresh(np.random.default_rng(1)))
    toxicity.fit(docs_of(spark, rows), labels)
    assert 0 < len(seen) <= 70 and max(map(len, seen)) <= 3 * 11


def test_texts_that_share_an_id_stay(spark):
    importable(spark)
    a, b, c = ("one two three four five six " * 9, "sieben acht neun zehn elf zwoelf " * 9, "un deux trois quatre cinq six sept " * 9)
    kept = simhash.keep_first(docs_of(spark, [(1, a), (1, b), (2, b), (2, c), (2, c), (None, a), (None, a), (3, None), (4, "")]))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, a), (1, b), (2, c), (0, a), (3, "")])


def test_one_measure_of_texts_gives_the_same_documents(spark):
    importable(spark)
    rows = [(i, f"A proper sentence number {i}, with words." if i % 2 else "### $$$ |||| 0000 " * (i + 1)) for i in range(120)] + [(None, None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = quality.fit_and_keep(docs, labels)
    model = quality.fit(quality.statistics_table(docs), labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in quality.keep_good(docs, model).collect())


def test_archives_are_read_in_as_many_tasks(spark):
    importable(spark)
    root = shared_root(spark)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(400)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        archives = warc.write_archives(warc.chunk_table(pages), root)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    read = warc.read_archives(spark, archives, root)
    tasks = read.select(F.spark_partition_id().alias("p"), "page_id").groupBy("p").count()
    assert archives.count() > 100 and tasks.count() == archives.count()
    assert read.count() == 400


def test_workers_hold_one_cache():
    one = storage.held("one", list)
    assert storage.held("one", list) is one
    storage.held("two", dict)
    assert storage.held("one", list) is not one


@pytest.mark.parametrize("rows", [[], [(1, None), (1, "a"), (1, "a"), (None, ""), (None, "x" * 20000)]])
def test_pipeline_of_nothing_and_of_odd_rows(spark, rows, tmp_path):
    importable(spark)
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    docs_of(spark, rows).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {i for i, _ in rows}
    assert bool(packed) == bool(rows)
