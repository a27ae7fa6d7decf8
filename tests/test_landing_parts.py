"""The payload landing in parts: nothing lost, and what was taken leaves the disk."""

from __future__ import annotations

import gzip
import os

import duckdb
from pyspark.sql import functions as F

from siftline.operators.normalise import complete_raw, unique_listings
from siftline.plans import feed_data as D
from siftline.plans import scratch
from siftline.plans.queries import feeds as queries
from siftline.plans.registry import ORACLES, QUERIES
from siftline.sources import payloads, registry
from siftline.streaming import ingest
from siftline.streaming.merge_store import MergeStore
from tests.test_merge_store import NOW, two_landings


def documents(spark, folder, n=130):
    rows = [(i, f"Text {i} & <b>more</b>\n\nof \"it\" é " + "word " * (i % 7), f"site{i % 3}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return rows


def files(root):
    return {os.path.relpath(os.path.join(at, name), root) for at, _, names in os.walk(root) for name in names if not name.startswith((".", "_"))}


def test_parts_hold_every_document_once_and_payloads_whole(spark, tmp_path):
    rows = documents(spark, tmp_path)
    parts = [[tuple(r) for r in part.collect()] for part in D.dealt(spark, str(tmp_path), str(tmp_path / "dealt"), 300, 5)]
    assert len(parts) == 5 and sorted(r for part in parts for r in part) == rows
    assert len({(r[0] // D.PER_PAYLOAD, k) for k, part in enumerate(parts) for r in part}) == len({r[0] // D.PER_PAYLOAD for r in rows})
    assert not files(tmp_path / "dealt")
    assert len(list(D.dealt(spark, str(tmp_path), str(tmp_path / "two"), 1 << 30, 5))) == 2


def test_documents_of_a_part_give_the_folders_payloads(spark, tmp_path):
    documents(spark, tmp_path)
    whole = sorted(map(str, D.all_payloads(spark, str(tmp_path)).filter("source <> 'hackernews'").collect()))
    parts = D.dealt(spark, str(tmp_path), str(tmp_path / "dealt"), 300, 5)
    assert whole == sorted(str(r) for part in parts for r in D.all_payloads(spark, part).filter("source <> 'hackernews'").collect())


def test_landed_files_are_read_as_they_were(spark, tmp_path):
    rows = [("lever", "a/b: 100% é", "lever-1", "[1,\n 2]\r\n"), ("lever", "acme", "l=2", "é中"), ("remotive", None, "r-1", ""), ("remotive", None, "r-2", None)]
    landed = spark.createDataFrame(rows, "source string, company string, payload_id string, body string")
    assert payloads.land(landed, str(tmp_path / "landing")) == 3
    found = payloads.read_landing(spark, str(tmp_path / "landing")).select("source", "company", F.coalesce("body", F.lit("")).alias("body"), "kind", "error")
    expected = [(s, c, b, "listings", None) for s, c, _, b in rows if b]
    assert sorted(r for r in map(tuple, found.collect()) if r[2]) == sorted(expected)
    again = files(tmp_path / "landing")
    assert payloads.land(landed, str(tmp_path / "landing")) == 3 and files(tmp_path / "landing") == again
    assert gzip.open(next(tmp_path.rglob("l%3D2.txt.gz"))).read().decode() == "é中"


def test_a_batch_leaves_no_copy_and_without_keep_no_records(spark, tmp_path):
    kept, bare = (MergeStore(spark, str(tmp_path / name), buckets=2) for name in ("kept", "bare"))
    sources = two_landings(str(tmp_path / "landing"), lambda *_: None)
    for store, keep in ((kept, True), (bare, False)):
        ingest.ingest_landing(spark, str(tmp_path / "landing"), store, sources, NOW, keep=keep)
        assert not [f for f in files(store.root) if f.startswith("landed")]
        assert bool([f for f in files(store.root) if f.startswith("records")]) == keep
    assert sorted(map(str, kept.current().collect())) == sorted(map(str, bare.current().collect())) and bare.current().count() == 4
    assert sorted(r["problem"] for r in ingest.quarantined(bare).collect()) == ["HTTP 500", "not valid JSON"]
    ingest.ingest_landing(spark, str(tmp_path / "landing"), bare, sources, NOW, checkpoint=str(tmp_path / "again"), keep=False)
    assert bare.current().count() == 4  # what was taken stays known


def test_unique_listings_are_shuffled_once(spark, tmp_path):
    sources = two_landings(str(tmp_path / "landing"), lambda *_: None)
    records = complete_raw(registry.union_sources(payloads.read_landing(spark, str(tmp_path / "landing")), sources)).drop("raw")
    store, shuffles = MergeStore(spark, str(tmp_path / "store"), buckets=3), spark.sparkContext._jsc.sc().newShuffleId
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    before = shuffles()
    store.upsert(unique_listings(records, NOW, registry.ORDER))
    assert shuffles() - before == 2  # its own and this call
    assert store.current().count() == 4 and spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_landing_stream_in_parts_leaves_listings_alone(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path)
    root = str(tmp_path / "scratch")
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: root)
    monkeypatch.setattr(queries, "PART_BYTES", 2500)
    rows = sorted(map(tuple, QUERIES["landing_stream"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == sorted(con.execute(ORACLES["landing_stream"]).fetchall())
    assert len(MergeStore(spark, f"{root}/store").manifest()) > 2
    assert {f.split("/")[0] for f in files(root)} == {"store"}
    assert not [f for f in files(f"{root}/store") if f.startswith(("landed", "records"))]
