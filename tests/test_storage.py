from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from siftline.operators import scoring, snapshots
from siftline.operators import views as V
from siftline.operators.dedupe import dedupe_first_wins
from siftline.operators.normalise import normalise, rejects, unique_listings
from siftline.operators.rules import load_rules
from siftline.plans import curation
from siftline.plans.listing_data import CRITERIA, NOW, PROFILE
from siftline.sources import registry
from siftline.sources.payloads import PAYLOAD
from siftline.streaming import ingest

RAW = "source string, url string, title string, company string, description string, posted_at_text string, source_priority int, ingest_pos bigint"
LATER = NOW + timedelta(days=7)


def raw(spark, *rows):
    full = [(s, u, t, "Acme", d, None, p, i) for i, (s, u, t, d, p) in enumerate(rows)]
    return spark.createDataFrame(full, RAW)


FIRST = (
    ("b", "https://x.com/1?utm_source=z", "One from b", "python", 1),
    ("a", "https://x.com/1", "One from a", "python", 0),
    ("a", "https://x.com/2", "Two", "docker", 0),
    ("a", "ftp://x.com/3", "Bad scheme", "", 0),
    ("a", "https://x.com/4", "  ", "", 0),
    ("a", "no url", "Bad", "", 0),
)


def test_first_source_wins_and_rejects_are_kept(spark):
    rows = raw(spark, *FIRST)
    unique = unique_listings(rows, NOW)
    assert {(r["source"], r["title"]) for r in unique.collect()} == {("a", "One from a"), ("a", "Two")}
    both = dedupe_first_wins(normalise(rows, NOW, keep=("source_priority", "ingest_pos"))).select(unique.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, unique.collect()))
    assert sorted(r["reject_reason"] for r in rejects(rows).collect()) == ["bad_url", "bad_url", "blank_title"]
    assert unique.count() == unique.select("id").distinct().count()


def test_input_order_does_not_matter(spark):
    rows = raw(spark, *FIRST)
    assert sorted(map(str, unique_listings(rows.orderBy(F.desc("ingest_pos")), NOW).collect())) == sorted(map(str, unique_listings(rows, NOW).collect()))


def test_upsert(spark):
    current = unique_listings(raw(spark, *FIRST), NOW)
    scrape = raw(spark, ("c", "https://x.com/1", "One renamed", "python", 2), ("a", "https://x.com/9", "Nine", "", 0))
    incoming = unique_listings(scrape, LATER)
    changes = {r["change"]: r["n"] for r in snapshots.classify_change(incoming, current).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert changes == {"updated": 1, "inserted": 1}
    merged = snapshots.upsert_snapshot(current, incoming)
    rows = {r["url"]: r for r in merged.collect()}
    one = rows["https://x.com/1"]
    assert (one["title"], one["source"]) == ("One renamed", "a")
    assert one["last_seen_at"] - one["first_seen_at"] == timedelta(days=7)
    assert set(rows) == {"https://x.com/1", "https://x.com/2", "https://x.com/9"}
    again = snapshots.upsert_snapshot(merged, incoming)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    report = snapshots.upsert_report(snapshots.classify_change(incoming, merged)).first()
    assert (report["inserted"], report["updated"], report["unchanged"], report["total"]) == (0, 0, 2, 2)


def test_user_state_last_write_and_clearing(spark):
    events = spark.createDataFrame(
        [("a", "status", "applied", 1), ("a", "status", "rejected", 3), ("a", "notes", "x", 2), ("a", "notes", None, 5), ("b", "notes", "y", 1), ("b", "eligibility_override", "eligible", 9)],
        "id string, field string, value string, seq bigint",
    )
    state = {r["id"]: (r["status"], r["notes"], r["eligibility_override"]) for r in snapshots.user_state(events).collect()}
    assert state == {"a": ("rejected", None, None), "b": ("new", "y", "eligible")}
    with pytest.raises(ValueError):
        snapshots.user_event(events, "title", F.lit("x"), F.lit(1))


def test_patches(spark):
    bodies = ['{"status":"applied","notes":null}', '{"notes":""}', '{"eligibility_override":"clear"}', '{"x":1}', '{"status":"hired"}', "[]", '{"status":"new"}']
    rows = [("known", b, i) for i, b in enumerate(bodies[:-1])] + [("other", bodies[-1], 6)]
    checked = snapshots.check_patches(spark.createDataFrame(rows, "id string, body string, seq bigint"), spark.createDataFrame([("known",)], "id string"))
    problems = {r["seq"]: r["problem"] for r in checked.collect()}
    assert problems == {0: None, 1: None, 2: None, 3: "unknown field", 4: "bad status", 5: "unreadable", 6: "unknown id"}
    events = {(r["seq"], r["field"], r["value"]) for r in snapshots.patch_events(checked).collect()}
    assert events == {(0, "status", "applied"), (1, "notes", None), (2, "eligibility_override", None)}


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    assert ingest.current_listings(spark, store).count() == 0
    first = raw(spark, *FIRST)
    first.write.parquet(landing)
    ingest.ingest_available(spark, landing, first.schema, store, NOW)
    second = raw(spark, ("c", "https://x.com/1", "One renamed", "python", 2))
    second.write.mode("append").parquet(landing)
    ingest.ingest_available(spark, landing, first.schema, store, LATER)
    ingest.ingest_available(spark, landing, first.schema, store, LATER)
    expected = snapshots.upsert_snapshot(unique_listings(first, NOW), unique_listings(second, LATER))
    assert sorted(map(str, ingest.current_listings(spark, store).collect())) == sorted(map(str, expected.collect()))
    before = ingest.committed_snapshots(spark, store)
    stream = ingest.stream_id(spark, f"{store}/stream")
    ingest.merge_batch(spark, store, second, stream, before[1], LATER, ("source_priority", "ingest_pos"))
    assert ingest.committed_snapshots(spark, store) == before


def test_a_new_checkpoint_skips_nothing(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    first = raw(spark, *FIRST)
    first.write.parquet(landing)
    ingest.ingest_available(spark, landing, first.schema, store, NOW)
    # The checkpoint is lost; what lands now is batch zero of another stream.
    raw(spark, ("a", "https://x.com/9", "Nine", "", 0)).write.mode("append").parquet(landing)
    ingest.ingest_available(spark, landing, first.schema, store, LATER, checkpoint=f"{store}/second")
    urls = {r["url"] for r in ingest.current_listings(spark, store).collect()}
    assert urls == {"https://x.com/1", "https://x.com/2", "https://x.com/9"}


def _payloads(spark, *titles):
    jobs = [{"url": f"https://x.com/{i}", "title": t, "description": "<p>Python, work from anywhere</p>", "company_name": "A"} for i, t in enumerate(titles)]
    return spark.createDataFrame([("remotive", None, "p", "listings", json.dumps({"jobs": jobs}), None)], PAYLOAD)


def test_two_full_runs(spark, tmp_path):
    store = curation.Store(spark, str(tmp_path))
    settings = curation.Settings(PROFILE, load_rules(), CRITERIA, batch_size=2)
    sources = registry.build_sources(["remotive"])
    titles = ["Backend Engineer", "Platform Engineer", "Data Engineer", "Recruiter"]
    ids = unique_listings(registry.union_sources(_payloads(spark, *titles), sources), NOW, registry.ORDER).select("id", "title")
    closed = ids.filter("title = 'Data Engineer'").select("id", F.lit(404).alias("http_status"), F.lit("text/html").alias("content_type"), F.lit("").alias("body"), F.lit(None).cast("string").alias("error"))
    report = curation.run_all(store, 1, [], _payloads(spark, *titles), sources, closed, settings, NOW).first()
    assert (report["fetched"], report["deduplicated"], report["eligible"], report["filtered_out"], report["verified"]) == (4, 4, 4, 2, 3)
    assert (report["normalised"], report["scored"], report["errors"]) == (4, 0, 0)
    assert {r["source"] for r in store.read("records", 1).collect()} == {"remotive"}
    batches = store.read("batches", 1)
    assert sorted((r["batch_id"], r["batch_index"]) for r in batches.collect()) == [(0, 1), (0, 2)]
    curation.export_prompts(store, 1, str(tmp_path / "out"))
    reply = spark.createDataFrame([(0, '{"results":[{"index":2,"score":150}]}')], "batch_id bigint, reply string")
    scored = curation.import_scores(store, 1, reply, "manual", NOW)
    second_in_batch = batches.filter("batch_index = 2").first()["id"]
    assert [(r["id"], r["match"]["score"]) for r in scored.collect()] == [(second_in_batch, 100)]
    assert curation.report(store, 1).first()["scored"] == 1

    users = spark.createDataFrame([(second_in_batch, "shortlisted", "mine", None)], "id string, status string, notes string, eligibility_override string")
    again = curation.run_all(store, 2, [1], _payloads(spark, "Renamed", "Platform Engineer", " ", titles[0]), sources, closed, settings, LATER, users).first()
    # Counters are this run's; what was scored is not planned again.
    assert (again["fetched"], again["normalised"], again["deduplicated"], again["scored"]) == (4, 3, 3, 0)
    assert again["verified"] == 1
    assert second_in_batch not in [r["id"] for r in store.read("batches", 2).collect()]
    view = curation.view(store, 2, [1, 2], users, scored=True)
    row = V.get_job(view, second_in_batch).first()
    assert (row["status"], row["notes"], row["match"]["score"]) == ("shortlisted", "mine", 100)
    assert V.list_jobs(view, limit=1).first()["id"] == second_in_batch


# --- scoring replies ---


def parse(spark, reply, size=3):
    replies = spark.createDataFrame([(0, reply)], "batch_id bigint, reply string")
    sizes = spark.createDataFrame([(0, size)], "batch_id bigint, batch_size bigint")
    rows = scoring.parse_responses(replies, sizes).orderBy("batch_index").collect()
    return [(r["batch_index"], r["score"]) for r in rows], scoring.malformed_batches(replies).count()


@pytest.mark.parametrize(
    "reply, expected, malformed",
    [
        ('{"results":[{"index":1,"score":87},{"index":3,"score":"61.9"}]}', [(1, 87), (3, 61)], 0),
        ('```json\n{"results":[{"index":1,"score":5}]}\n```', [(1, 5)], 0),
        ('Sure: {"results":[{"index":"2","score":-4.5}]} ok', [(2, 0)], 0),
        ('{"results":[{"index":1,"score":5},{"index":1,"score":9}]}', [(1, 5)], 0),
        ('{"results":[{"index":0,"score":5},{"index":4,"score":5},{"score":5},{"index":1}]}', [], 0),
        ('{"results":[{"index":1,"score":true},{"index":true,"score":1},{"index":2,"score":"NaN"},{"index":3,"score":"8d"}]}', [], 0),
        ('{"results":[{"index":1,"score":1e99},"x",null,[1]]}', [(1, 100)], 0),
        ('{"results":[]}', [], 0),
        ('{"results":{}}', [], 1),
        ("[]", [], 1),
        ("no idea", [], 1),
        ("", [], 1),
    ],
)
def test_replies(spark, reply, expected, malformed):
    assert parse(spark, reply) == (expected, malformed)


def test_paging_bounds(spark):
    frame = spark.range(3).withColumnRenamed("id", "x")
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            V.page(frame, limit, offset)
