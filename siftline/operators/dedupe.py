"""First-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first_wins(
    listings: DataFrame, order: Sequence[str] = ("source_priority", "ingest_pos"), key: str = "id"
) -> DataFrame:
    """One row per id: the first in source order, then in feed order.

    The ``row_number() = 1`` filter lets Spark prune to one row per id inside
    every map task before the shuffle, so an id that fills a third of the input
    sends at most one row per task. ``dropDuplicates`` would keep an arbitrary
    row instead.
    """
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc() for c in order])
    return listings.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
