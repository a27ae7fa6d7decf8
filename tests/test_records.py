"""Records, problems, counters and durations from one reading of the payloads."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siftline.operators.normalise import drop_unusable
from siftline.plans import curation
from siftline.plans import feed_data as D
from siftline.sources import registry
from siftline.sources.payloads import read_landing
from tests.test_merge_store import NOW, land, two_landings

SF = "/root/testdata/sf0.001"
COMPANIES = {name: [f"board{i}" for i in range(D.BOARDS)] for name in ("greenhouse", "lever", "ashby")}


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Other tests look at plans, where cached tables would show."""
    yield
    spark.catalog.clearCache()


def test_entries_are_records_and_problems(spark):
    sources = registry.build_sources(registry.available_sources(), COMPANIES)
    landed = D.all_payloads(spark, SF).cache()
    entries = registry.union_entries(landed, sources).cache()
    both = registry.problems_of(entries), registry.source_problems(landed, sources)
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
    rows, want = entries.filter("problem IS NULL").drop("problem"), registry.union_sources(landed, sources)
    assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_payloads_are_parsed_once_for_both(spark):
    sources = registry.build_sources(["lever", "remotive"], COMPANIES)
    landed = D.lever(spark, SF).unionByName(D.remotive(spark, SF))
    optimised = registry.union_entries(landed, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("parseJson") == 2  # one place for each feed


def test_a_feed_of_ones_own_is_read_twice(spark):
    own = registry.REGISTRY["remotive"]
    sources = {"remotive": registry.Feed(own.read, own.problems)}
    landed = D.remotive(spark, SF)
    assert registry.union_entries(landed, sources).filter("problem IS NULL").count() == own.read(landed).count()


def test_counters_and_durations_of_a_landing(spark, tmp_path):
    landing = str(tmp_path / "landing")
    sources = two_landings(landing, lambda *_: None)
    land(landing, "remotive", "e.json", '{"jobs": [{"id": 9, "url": "ftp://x/y", "title": "Bad address"}, {"id": 8, "url": "https://x.com/8", "title": " "}]}')
    for name, at in (("a.json", 1000.0), ("c.json", 1090.5), ("d.json", 1030.0), ("e.json", 1001.0)):
        os.utime(f"{landing}/source=remotive/company=__HIVE_DEFAULT_PARTITION__/{name}", (at, at))
    store = curation.Store(spark, str(tmp_path / "store"))
    curation.collect(store, 1, None, read_landing(spark, landing), sources, NOW)
    counters = {r["name"]: r["n"] for r in store.counters(1).collect()}
    records = curation.stored_records(store, 1)
    assert counters == {"fetched": records.count(), "normalised": drop_unusable(records).count(), "deduplicated": store.read("listings", 1).count(), "errors": 0}
    assert (counters["fetched"], counters["normalised"], counters["deduplicated"]) == (7, 5, 4)
    outcomes = {r["source"]: (r["fetched"], r["failed_payloads"], r["seconds"]) for r in store.read("source_runs", 1).collect()}
    assert outcomes["remotive"] == (6, 1, 90.5) and outcomes["lever"][:2] == (1, 1)


def test_report_reads_counters_alone(spark, tmp_path):
    store = curation.Store(spark, str(tmp_path))
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    store.write("incoming", 1, rows, deduplicated=F.count(F.lit(1)))
    store.write("incoming", 1, rows.limit(4), deduplicated=F.count(F.lit(1)))
    store.write("drops", 1, rows.filter("id < 0").withColumn("drop_reason", F.lit("x")), filtered_out=F.count("drop_reason"))
    report = curation.report(store, 1).first()
    assert (report["run_id"], report["deduplicated"], report["filtered_out"], report["scored"]) == (1, 4, 0, 0)
