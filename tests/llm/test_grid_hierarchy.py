"""The hierarchy of the grid join: the same pairs as all boxes compared, the same
links as all vectors compared, with many small blocks and levels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import grid_join
from siftline.llm.storage import importable


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 4)
    monkeypatch.setattr(grid_join, "BITS", 1)


def clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, (centres[rng.integers(12)] + rng.normal(scale=0.25, size=8)).tolist(), 1 if i % 5 else 2) for i in range(n)]


def distinct_of(spark, rows):
    frame = spark.createDataFrame([(label, len(v), i, 1, v) for i, v, label in rows], "label int, size int, id long, copies long, v array<double>")
    return frame.repartition(3)


def test_pairs_equal_all_boxes_compared(spark, small_blocks):
    importable(spark)
    eps = float(np.sqrt(2 - 2 * 0.93))
    table = grid_join.numbered(grid_join.blocks(distinct_of(spark, clusters(300)), eps))
    boxes = table.collect()
    assert sorted(b["at"] for b in boxes) == list(range(len(boxes)))
    assert len(boxes) > 64 and all(len(b["ids"]) <= 4 for b in boxes)
    want = set()
    for p in boxes:
        for q in boxes:
            gap = np.maximum(np.maximum(np.array(p["lo"]) - q["hi"], np.array(q["lo"]) - p["hi"]), 0)
            if (p["label"], p["size"]) == (q["label"], q["size"]) and p["at"] <= q["at"] and gap @ gap <= (eps + grid_join.SLACK) ** 2:
                want.add((p["at"], q["at"]))
    got = [(r["a"], r["b"]) for r in grid_join.block_pairs(table, eps).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) < len(boxes) * (len(boxes) + 1) // 2


def test_links_over_many_levels_and_a_hot_vector(spark, small_blocks):
    importable(spark)
    rows = clusters(160)
    hot = rows[1][1]
    rows += [(1000 + k, hot, rows[1][2]) for k in range(90)] + [(2000, [-0.0, 1.0] + [0.0] * 6, 1), (2001, [0.0, 1.0] + [0.0] * 6, 1)]
    unit = grid_join._unit(np.array([v for _, v, _ in rows]))
    labels = np.array([label for _, _, label in rows])
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    reach = linked | np.eye(len(rows), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([i for i, _, _ in rows])
    want = {int(ids[k]): (int(linked[k].sum()), int(ids[reach[k]].min())) for k in range(len(rows))}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in grid_join.similar_vectors(frame).collect()}
    assert got == want
