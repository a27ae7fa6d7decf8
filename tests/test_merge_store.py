"""Generations merged on read, compaction, and the stream over landed responses."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siftline.operators.normalise import complete_raw, unique_listings
from siftline.operators.snapshots import upsert_snapshot
from siftline.plans import listing_data as L
from siftline.schema import LISTING
from siftline.sources import registry
from siftline.sources.payloads import read_landing
from siftline.streaming import ingest
from siftline.streaming.merge_store import MergeStore

SF = "/root/testdata/sf0.001"
NOW = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
LATER = NOW + timedelta(days=7)


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Other tests look at plans, where cached tables would show."""
    yield
    spark.catalog.clearCache()


def plain(listings):
    return sorted(map(str, listings.select(*LISTING.names).collect()))


@pytest.fixture(scope="module")
def scrapes(spark):
    first, second = L.listings(spark, SF), unique_listings(L.second_scrape(spark, SF), LATER)
    return first.cache(), second.cache()


def test_generations_equal_snapshots(spark, scrapes, tmp_path):
    first, second = scrapes
    store = MergeStore(spark, str(tmp_path), buckets=4)
    assert store.current().count() == 0 and store.files() == {}
    store.upsert(first, "s", 0)
    assert plain(store.current()) == plain(first)
    assert store.upsert(second, "s", 1) == 2 and store.upsert(second, "s", 1) is None
    want = plain(upsert_snapshot(first, second))
    assert plain(store.current()) == want
    assert store.compact(most_files=1) == 3
    assert plain(store.current()) == want  # replaced files are still there, and harmless
    assert store.vacuum() == 8 and plain(store.current()) == want
    assert {gen for gen, _ in store.files()} == {3}
    # A third scrape, of other rows, by a reader that starts afresh.
    third = first.limit(20).withColumn("title", F.lit("Third"))
    other = MergeStore(spark.newSession(), str(tmp_path))
    other.upsert(other.spark.createDataFrame(third.collect(), third.schema), "s", 2)
    assert plain(store.current()) == plain(upsert_snapshot(upsert_snapshot(first, second), third))


def test_reading_moves_nothing(spark, scrapes, tmp_path):
    store = MergeStore(spark, str(tmp_path), buckets=4)
    for batch, rows in enumerate(scrapes):
        store.upsert(rows, "s", batch)
    plan = store.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_untouched_buckets_keep_their_files(spark, scrapes, tmp_path):
    store = MergeStore(spark, str(tmp_path), buckets=4)
    store.upsert(scrapes[0], "s", 0)
    bucket = F.pmod(F.hash("id"), F.lit(4))
    for batch in (1, 2):
        store.upsert(scrapes[1].filter(bucket == 2), "s", batch)
    before = store.files()
    want = plain(store.current())
    store.compact(most_files=2)
    store.vacuum()
    after = store.files()
    assert {k: v for k, v in before.items() if k[1] != 2} == {k: v for k, v in after.items() if k[1] != 2}
    assert [k for k in after if k[1] == 2] == [(4, 2)]
    assert plain(store.current()) == want
    assert store.compact(most_files=2) is None


def test_only_committed_generations_are_read(spark, scrapes, tmp_path):
    store = MergeStore(spark, str(tmp_path), buckets=4)
    store.upsert(scrapes[0], "s", 0)
    want = plain(store.current())
    # An attempt that died before its manifest line.
    torn = scrapes[1].withColumns({"first_gen": F.lit(2).cast("long"), "last_gen": F.lit(2).cast("long")})
    torn.write.parquet(f"{tmp_path}/rows/gen=2")
    assert plain(store.current()) == want
    store.upsert(scrapes[1].limit(3), "s", 1)
    assert plain(store.current()) == plain(upsert_snapshot(scrapes[0], scrapes[1].limit(3)))


def test_empty_batches_and_rows_without_id(spark, scrapes, tmp_path):
    store = MergeStore(spark, str(tmp_path), buckets=2)
    store.upsert(scrapes[0].limit(0), "s", 0)
    assert store.current().count() == 0
    store.upsert(scrapes[0].limit(2).withColumn("id", F.lit(None).cast("string")), "s", 1)
    assert store.current().count() == 0 and store.manifest()[-1]["gen"] == 2


def land(root, source, name, body, company=None):
    folder = os.path.join(root, f"source={source}", f"company={company or '__HIVE_DEFAULT_PARTITION__'}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.write(body)


def board(*jobs):
    return json.dumps({"jobs": [{"id": i, "url": f"https://jobs.example.com/{i}", "title": t, "company_name": "Acme", "description": "<p>Python\n\nwork</p>"} for i, t in jobs]})


SOURCES = ["remotive", "lever"]


def two_landings(landing, times):
    sources = registry.build_sources(SOURCES, {"lever": ["acme"]})
    land(landing, "remotive", "a.json", board((1, "One"), (2, "Two")))
    land(landing, "lever", "b.json", json.dumps([{"id": "x", "text": "Lever\njob", "hostedUrl": "https://jobs.example.co/x"}]), "acme")
    land(landing, "lever", "b.error", " HTTP 500 ", "acme")
    times(sources, NOW)
    land(landing, "remotive", "c.json", board((2, "Two again"), (3, "Three")))
    land(landing, "remotive", "d.json", "not json")
    times(sources, LATER)
    return sources


@pytest.mark.parametrize("most_files", [None, 1])
def test_stream_over_the_landing_equals_batch_runs(spark, tmp_path, most_files):
    landing, store = str(tmp_path / "landing"), MergeStore(spark, str(tmp_path / "store"), buckets=4)
    seen, current = [], [spark.createDataFrame([], LISTING)]

    def run(sources, now):
        ingest.ingest_landing(spark, landing, store, sources, now, most_files=most_files)
        new = read_landing(spark, landing).filter(~F.col("payload_id").isin(seen or [""]))
        rows = unique_listings(complete_raw(registry.union_sources(new, sources)).drop("raw"), now, registry.ORDER).collect()
        seen.extend(r["payload_id"] for r in read_landing(spark, landing).select("payload_id").collect())
        current[0] = spark.createDataFrame(upsert_snapshot(current[0], spark.createDataFrame(rows, LISTING)).collect(), LISTING)

    two_landings(landing, run)
    assert plain(store.current()) == plain(current[0])
    assert {r["title"] for r in store.current().collect()} == {"One", "Two again", "Three", "Lever job"}
    problems = {(r["source"], re.sub(".*/", "", r["payload_id"]), r["problem"]) for r in ingest.quarantined(store).collect()}
    assert problems == {("lever", "b.error", "HTTP 500"), ("remotive", "d.json", "not valid JSON")}


def test_a_lost_checkpoint_loses_nothing(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), MergeStore(spark, str(tmp_path / "store"), buckets=4)
    sources = two_landings(landing, lambda sources, now: ingest.ingest_landing(spark, landing, store, sources, now))
    before = store.current().select("id", "title", "first_seen_at").collect()
    commits = len(store.manifest())
    ingest.ingest_landing(spark, landing, store, sources, LATER)
    assert len(store.manifest()) == commits  # nothing new landed
    ingest.ingest_landing(spark, landing, store, sources, LATER, checkpoint=str(tmp_path / "again"))
    assert sorted(store.current().select("id", "title", "first_seen_at").collect()) == sorted(before)


def test_a_batch_opens_each_response_once(spark, tmp_path, monkeypatch):
    """Every feed reads the folder of its own responses, not the whole batch."""
    landing, met, union = str(tmp_path / "landing"), [], registry.union_entries

    def watch(landed, sources):
        places = landed.select("source", F.col("_metadata.file_path").alias("place"))
        met.append({(r["source"], re.search(r"/store/landed/.*/source=(\w+)/", r["place"])[1]) for r in places.collect()})
        met.append(sorted(map(str, landed.select("source", "company", "payload_id", "kind", "body", "error").collect())))
        return union(landed, sources)

    bodies = {"source=remotive/company=x/a.json": '{"jobs":[{"id":1,"url":"https://e.org/1","title":"A"}]}', "source=lever/company=acme/b.json": "[]", "source=lever/company=acme/c.error": " gone "}
    for name, body in bodies.items():
        os.makedirs(os.path.dirname(f"{landing}/{name}"), exist_ok=True)
        with open(f"{landing}/{name}", "w") as f:
            f.write(body)
    monkeypatch.setattr(registry, "union_entries", watch)
    store, setting = MergeStore(spark, str(tmp_path / "store"), buckets=2), spark.conf.get(ingest.LISTING_TASKS)
    ingest.ingest_landing(spark, landing, store, registry.build_sources(("remotive", "lever"), {"lever": ["acme"]}), NOW)
    places, rows = met
    assert places == {("remotive", "remotive"), ("lever", "lever")}
    assert rows == sorted(map(str, read_landing(spark, landing).select("source", "company", "payload_id", "kind", "body", "error").collect()))
    assert store.current().count() == 1 and ingest.quarantined(store).count() == 1
    assert spark.conf.get(ingest.LISTING_TASKS) == setting
