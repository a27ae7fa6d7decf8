"""A commit reads the buckets of its own ids only."""

from __future__ import annotations

from siftline.llm import token_counts
from siftline.llm.storage import importable, shared_root

FEED = "doc_id long, source string, lang string, text string, seq int, op string"


def test_a_small_commit_reads_its_buckets(spark):
    importable(spark)
    rollup = token_counts.Rollup(spark, shared_root(spark), buckets=8)
    feed = [(i, "s", "en", f"word {i} more", 0, "upsert") for i in range(200)] + [(None, "s", "en", "no id", 0, "upsert")]
    rollup.commit(0, spark.createDataFrame(feed, FEED))
    rollup.commit(1, spark.createDataFrame([(7, "s", "en", "one", 0, "upsert"), (900, "t", "en", "new one", 0, "upsert")], FEED))
    found = rollup.earlier(1)
    assert [(r["doc_id"], r["batch"]) for r in found.collect()] == [(7, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(doc_id,7)" in plan and "LessThanOrEqual(doc_id,900)" in plan
    rollup.commit(2, spark.createDataFrame([(7, None, None, None, 0, "delete")], FEED))
    rollup.commit(3, spark.createDataFrame([], FEED))
    rollup.commit(4, spark.createDataFrame([(None, "s", "en", "again no id", 0, "upsert")], FEED))
    assert not rollup.commit(2, spark.createDataFrame([(7, None, None, None, 0, "delete")], FEED))
    totals = {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert totals["s", "words-1"] == (199 + 2, 199 * 3 + 2 + 3) and totals["t", "words-1"] == (1, 2)
