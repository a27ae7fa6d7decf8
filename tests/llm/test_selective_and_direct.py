"""Selective reads of token files, and quality scores against a direct solution."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from siftline.llm import quality, token_files
from siftline.llm.encoding import Encoder
from siftline.llm.queries import vocabulary
from siftline.llm.storage import importable, shared_root


def scanned(frame):
    """Rows that the scan itself gave out, before any filter."""
    rows = frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_selective_reads_fetch_some_pages_only(spark):
    importable(spark)
    texts = {i: f"text number {i} of many, some words long" for i in range(0, 16000, 2)}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (8, "again")], "doc_id long, text string").coalesce(1)
    path, library = shared_root(spark), Encoder(vocabulary("word_bpe_49k.json"))
    token_files.write_token_files(docs, path, vocabulary("word_bpe_49k.json"))
    rows, read = scanned(token_files.read_tokens(spark, path, [8, 4001, 12000, 12000]))
    want = [(i, library.whole(t) + [1]) for i, t in ((8, texts[8]), (8, "again"), (12000, texts[12000]))]
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == sorted(want)
    # Pages of 1,000 rows; one or two around each id, of 8,002 rows.
    assert read <= 5 * token_files.PAGE_ROWS
    lengths = token_files.read_tokens(spark, path, [2], ["n_tokens"])
    assert [r["n_tokens"] for r in lengths.collect()] == [len(library.whole(texts[2])) + 1]
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan and "EqualTo(doc_id,2)" in plan
    many = token_files.read_tokens(spark, path, range(0, 1999, 2))
    assert many.count() == 1001
    assert token_files.read_tokens(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        token_files.read_tokens(spark, path, range(token_files.MOST_IDS + 1))


def pools_directly(ones, counts):
    """Isotonic levels by the min-max formula; equal neighbours share a pool."""
    n = len(ones)
    mean = lambda a, b: ones[a : b + 1].sum() / counts[a : b + 1].sum()
    level = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    out = np.zeros(n)
    for i in range(n):
        same = np.isclose(level, level[i], rtol=0, atol=1e-12)
        out[i] = (ones[same].sum() + 0.5) / (counts[same].sum() + 1)
    return out


def test_quality_equals_a_direct_solution(spark):
    importable(spark)
    rng = random.Random(8)
    rows = []
    for i in range(200):
        words = [rng.choice(["river", "stone", "Bird", "sings", "42", "a"]) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(w + ("|" if rng.random() < 0.3 * (i % 2) else "") for w in words), i % 2 if rng.random() < 0.9 else 1 - i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 9], "doc_id long, quality int")
    stats = quality.statistics_table(docs)
    got = {r["doc_id"]: r["score"] for r in quality.scores(stats, quality.fit(stats, labels)).collect()}

    train = [(t, y) for i, t, y in rows if i % 9 and zlib.crc32(str(i).encode()) % 5]
    x = np.array([quality.statistics(t) for t, _ in train])
    y = np.array([v for _, v in train], float)
    mean, spread = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    random_ = np.random.default_rng(quality.SEED)
    directions = random_.normal(size=(x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1])
    phases = random_.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(texts):
        out = []
        for text in texts:
            z = np.clip((quality.statistics(text) - mean) / spread, -6, 6)
            out.append([1.0] + [np.sqrt(2 / quality.FEATURES) * np.cos(z @ directions[:, k] + phases[k]) for k in range(quality.FEATURES)])
        return np.array(out)

    # Ridge as least squares with a row for each weight's penalty, none for the constant.
    z = features([t for t, _ in train])
    penalty = np.sqrt(quality.RIDGE * len(y) / quality.FEATURES) * np.eye(quality.FEATURES + 1)[1:]
    weights = np.linalg.lstsq(np.vstack([z, penalty]), np.append(y, np.zeros(len(penalty))), rcond=None)[0]
    cell = np.clip((z @ weights + 0.5) / 2 * quality.GRID, 0, quality.GRID - 1).astype(int)
    there = np.unique(cell)
    counts, ones = np.array([(cell == c).sum() for c in there]), np.array([y[cell == c].sum() for c in there])
    knots = (there + 0.5) / quality.GRID * 2 - 0.5
    want = np.interp(features([t for _, t, _ in rows]) @ weights, knots, pools_directly(ones, counts))
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=1e-6)
