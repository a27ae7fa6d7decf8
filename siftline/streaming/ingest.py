"""Incremental ingest: new landed records become the next listings snapshot.

The stream only tracks which files were taken. Each micro-batch is merged into
the snapshot exactly as a batch scrape is, so the two ways of loading give the
same table, and a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.operators.normalise import complete_raw, unique_listings
from siftline.operators.snapshots import upsert_snapshot
from siftline.schema import LISTING
from siftline.sources import payloads, registry
from siftline.streaming.merge_store import MergeStore

LOG = "snapshot_log"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"


def committed_snapshots(spark: SparkSession, store: str, stream: str | None = None) -> tuple[int, int]:
    """The last committed version, and the last batch of the given stream in it or
    before (of any stream without one); zero and -1 before the first."""
    try:
        log = spark.read.schema("version bigint, stream string, batch bigint").json(f"{store}/{LOG}")
        # Batch numbers count within one checkpoint only.
        of_stream = F.col("batch") if stream is None else F.when(F.col("stream") == stream, F.col("batch"))
        last = log.agg(F.max("version").alias("version"), F.max(of_stream).alias("batch")).first()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return 0, -1
        raise
    return last["version"] or 0, -1 if last["batch"] is None else last["batch"]


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as it keeps its checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def current_listings(spark: SparkSession, store: str) -> DataFrame:
    """The newest committed snapshot; empty before the first."""
    version, _ = committed_snapshots(spark, store)
    if not version:
        return spark.createDataFrame([], LISTING)
    return spark.read.schema(LISTING).parquet(f"{store}/listings/version={version}")


def merge_batch(
    spark: SparkSession, store: str, raw: DataFrame, stream: str, batch: int, now: datetime, order: Sequence[str]
) -> None:
    """Write the next snapshot, then commit it by one log row.

    A batch that its stream has already committed is skipped; a stream with a new
    checkpoint counts from zero again and loses nothing. Files of an uncommitted
    attempt are overwritten by the retry; readers never see them.
    """
    version, done = committed_snapshots(spark, store, stream)
    if done >= batch:
        return
    version += 1
    merged = upsert_snapshot(current_listings(spark, store), unique_listings(raw, now, order))
    merged.write.mode("overwrite").parquet(f"{store}/listings/version={version}")
    row = spark.createDataFrame([(version, stream, batch)], "version bigint, stream string, batch bigint")
    row.coalesce(1).write.mode("append").json(f"{store}/{LOG}")


def ingest_available(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    store: str,
    now: datetime,
    order: Sequence[str] = ("source_priority", "ingest_pos"),
    checkpoint: str | None = None,
) -> None:
    """Take everything that landed since the last call, then stop."""
    place = checkpoint or f"{store}/stream"
    raw = spark.readStream.schema(schema).parquet(landing)
    writer = raw.writeStream.foreachBatch(
        lambda batch, number: merge_batch(
            batch.sparkSession, store, batch, stream_id(batch.sparkSession, place), number, now, order
        )
    )
    run = writer.option("checkpointLocation", place).trigger(availableNow=True).start()
    run.awaitTermination()


def take_payloads(store: MergeStore, landed: DataFrame, sources: dict, stream: str, batch: int, now: datetime, keep: bool = True) -> None:
    """One batch of landed responses: records to the store, failures aside.

    Responses are parsed once, into a table of raw records and failures under the
    batch; then the store commits the listings. A batch done again overwrites its own folders and commits nothing twice.
    A stream's batch cannot skip other feeds' files, so its responses are copied into
    a folder for each feed: a file is opened once, and not by every feed. The copy
    goes when the records are there. Without ``keep`` these go too, once they are
    committed; listings, failures and the taken responses' ids always stay.
    """
    if store.done(stream, batch):
        return
    # A stream's batches belong to a session of their own.
    store = replace(store, spark=landed.sparkSession)
    place = f"stream={stream}/batch={batch}"
    landed = _not_taken(store, landed, stream)
    copied = f"{store.root}/landed/{place}"
    landed.write.mode("overwrite").option("compression", "zstd").partitionBy("source").parquet(copied)
    landed = store.spark.read.schema(landed.schema).parquet(copied)
    landed.select("payload_id").write.mode("overwrite").parquet(f"{store.root}/taken/{place}")
    entries = f"{store.root}/records/{place}"
    complete_raw(registry.union_entries(landed, sources)).write.mode("overwrite").option("compression", "zstd").parquet(entries)
    store.remove(copied)
    parsed = store.spark.read.parquet(entries)
    registry.problems_of(parsed).write.mode("overwrite").parquet(f"{store.root}/quarantine/{place}")
    records = parsed.filter("problem IS NULL").drop("raw", "problem", payloads.LANDED)
    store.upsert(unique_listings(records, now, registry.ORDER), stream, batch)
    if not keep:
        store.remove(entries)


def _not_taken(store: MergeStore, landed: DataFrame, stream: str) -> DataFrame:
    """The responses that no other stream's committed batch has taken.

    Only after a lost checkpoint is there another stream; then its older responses
    must not come in again, as newer ones may have replaced what they say.
    """
    others = sorted({(c["stream"], c["batch"]) for c in store.manifest() if c["kind"] == "batch" and c["stream"] != stream and c["batch"] is not None})
    if not others:
        return landed
    spark = store.spark
    committed = spark.createDataFrame(others, "stream string, batch bigint")
    taken = spark.read.schema("payload_id string, stream string, batch bigint").parquet(f"{store.root}/taken")
    return landed.join(taken.join(committed, ["stream", "batch"], "left_semi").select("payload_id"), "payload_id", "left_anti")


def ingest_landing(
    spark: SparkSession, landing: str, store: MergeStore, sources: dict, now: datetime, checkpoint: str | None = None, most_files: int | None = None,
    keep: bool = True,
) -> None:
    """Take every response that landed since the last call, then stop.

    ``landing`` has the layout of :func:`payloads.read_landing`. After a lost
    checkpoint a new stream meets everything again and leaves out what is committed.
    Nothing is deleted there; ``keep`` is as in :func:`take_payloads`.
    """
    place = checkpoint or f"{store.root}/stream"

    def take(batch: DataFrame, number: int) -> None:
        take_payloads(store, batch, sources, stream_id(spark, place), number, now, keep)

    query = payloads.stream_landing(spark, landing, most_files).writeStream.foreachBatch(take)
    # A batch's files are looked up with a task each, up to 10,000 tasks, unless the
    # session that made the stream says otherwise while it runs. A response is small,
    # and at the usual cost of opening it each task would read, and write, very few.
    before = {name: spark.conf.get(name) for name in (LISTING_TASKS, OPEN_COST)}
    spark.conf.set(LISTING_TASKS, min(int(before[LISTING_TASKS]), 4 * spark.sparkContext.defaultParallelism))
    spark.conf.set(OPEN_COST, "64k")
    try:
        query.option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def quarantined(store: MergeStore) -> DataFrame:
    """Responses that could not be read, with stream and batch."""
    return store.spark.read.parquet(f"{store.root}/quarantine")
