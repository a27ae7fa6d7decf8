"""Writing results: snapshots, prompt batches and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.pay import format_compensation
from siftline.operators.eligibility import summary
from siftline.operators.views import effective


def sink_snapshot(listings: DataFrame, path: str) -> None:
    """Write one listings snapshot. Files split by source, so a source filter
    skips the others' files; large sources spread over many files."""
    listings.write.mode("errorifexists").partitionBy("source").parquet(path)


def sink_bucketed_snapshot(listings: DataFrame, table: str, buckets: int) -> None:
    """Write a snapshot as a table bucketed by id.

    The next upsert then joins on the stored layout and shuffles only the new
    scrape. Use at least as many buckets as shuffle partitions.
    """
    by_id = listings.repartition(buckets, "id")
    by_id.write.mode("errorifexists").bucketBy(buckets, "id").sortBy("id").format("parquet").saveAsTable(table)


def sink_prompt_batches(prompts: DataFrame, path: str) -> None:
    """One text file per batch, under ``batch_id=<n>``."""
    spread = prompts.repartition("batch_id")
    spread.select("batch_id", F.col("prompt").alias("value")).write.mode("errorifexists").partitionBy("batch_id").text(path)


def csv_rows(view: DataFrame) -> DataFrame:
    """The listing table flattened to text-friendly columns."""
    return view.select(
        "id",
        "source",
        "url",
        "title",
        "company",
        "location_text",
        "contract_type",
        format_compensation(F.col("compensation")).alias("compensation"),
        F.array_join("tags", ",").alias("tags"),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"),
        effective().alias("eligibility"),
        summary(F.col("eligibility")).alias("eligibility_summary"),
        F.col("verification.tier").alias("verification"),
        F.col("match.score").alias("match_score"),
        "prescore",
        "status",
        "notes",
    )


def sink_csv_export(view: DataFrame, path: str) -> None:
    csv_rows(view).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
