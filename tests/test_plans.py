"""What the plans must and must not contain."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
import check
from siftline.plans import listing_data as L
from siftline.plans.registry import ORACLES, QUERIES
from tests.conftest import SF


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_dedupe_prunes_before_the_shuffle(spark):
    text = plan(L.listings(spark, SF))
    tree = text[: text.index("\n\n\n")]
    assert tree.count("WindowGroupLimit") == 2 and tree.count("Exchange") == 1


def test_labelling_adds_no_shuffle(spark):
    tree = plan(L.labelled(spark, SF))
    assert tree[: tree.index("\n\n\n")].count("Exchange") == 1


@pytest.mark.parametrize("name", ["eligibility_counts", "rank", "upsert_snapshot", "stats", "parse_responses", "union_sources"])
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in text


def test_topk_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["topk_pending"](spark, SF))


def test_every_listing_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["canonical_url", "html_to_text", "unique_listings", "explain_dimensions", "drop_counts", "combine_verification", "rank", "upsert_snapshot", "read_ashby", "stats"])
def test_query_equals_sql(spark, name):
    good, note = check.compare(spark, check.database(SF), name, SF)
    assert good, note


def test_entry(spark):
    assert {r["eligibility"] for r in entry.entry(spark).collect()} == {"eligible", "ineligible", "unknown"}


def test_bucketed_snapshot_is_not_shuffled_again(spark, tmp_path):
    from siftline.operators.snapshots import upsert_snapshot
    from siftline.sources.sinks import sink_bucketed_snapshot

    current = L.listings(spark, SF)
    table = f"snapshot_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS curated_{table} LOCATION '{tmp_path}/db'")
    sink_bucketed_snapshot(current, f"curated_{table}.{table}", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        incoming = spark.createDataFrame([], current.schema).repartition(3)
        merged = upsert_snapshot(spark.table(f"curated_{table}.{table}"), incoming)
        text = plan(merged)
        tree = text[: text.index("\n\n\n")]
        stored = tree[tree.index("SortMergeJoin") :].split("Scan parquet")[0]
        assert "Exchange" not in stored
        assert merged.count() == current.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
