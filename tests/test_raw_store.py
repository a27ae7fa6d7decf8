"""Retained records: read by path from columns of their own, nothing lost."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftline.plans.scratch import scratch_dir
from siftline.sources import raw_store

COLUMNS = "source string, payload_id string, raw string"


def stored(spark, rows):
    path, records = scratch_dir(spark), spark.createDataFrame(rows, COLUMNS)
    raw_store.retain(records, path)
    return raw_store.read_retained(spark, path, records.schema)


def test_paths_reach_the_scan(spark):
    rows = [("a" if k % 2 else "b", str(k), json.dumps({"id": k, "pay": {"min": 10 * k}, "body": "x" * 200, "tags": ["t"]})) for k in range(400)]
    kept = stored(spark, rows)
    found = kept.filter((raw_store.at("$.pay.min", "bigint") == 770) & (F.col("source") == "a")).select("payload_id", raw_store.at("$.id", "bigint").alias("n"))
    assert [tuple(r) for r in found.collect()] == [("77", 77)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    # Two numbers of the record are read, not the record.
    assert "raw:struct<0:bigint,1:bigint>" in scan and "variant" not in scan.split("ReadSchema")[1]
    assert "PushedFilters" in scan and "770" in scan.split("PushedFilters")[1]
    assert "PartitionFilters" in scan and "source" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_nothing_is_lost(spark):
    texts = ['{"id": 1, "pay": "high"}', '{"id": "x", "pay": {"min": 5}}', "[1, 2]", "null", "not json {", None, "", '{"id": 12345678901234567890, "é": "日本 😀"}', '{"id": 1, "pay": "high"}']
    kept = stored(spark, [("a", str(k), t) for k, t in enumerate(texts)])
    rows = {r["payload_id"]: r for r in kept.select("payload_id", F.to_json("raw").alias("json"), "raw_text", raw_store.at("$.id").alias("id"), raw_store.at("$.pay.min", "bigint").alias("pay")).collect()}
    for k, text in enumerate(texts):
        row = rows[str(k)]
        if text in ("not json {", "", None):
            assert (row["json"], row["raw_text"]) == (None, text)
        else:
            assert json.loads(row["json"]) == json.loads(text) and row["raw_text"] is None
    assert [(rows[k]["id"], rows[k]["pay"]) for k in "0127"] == [("1", None), ("x", 5), (None, None), ("12345678901234567890", None)]


def test_no_records(spark):
    assert stored(spark, []).count() == 0
