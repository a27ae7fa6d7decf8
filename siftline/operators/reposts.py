"""Repost patterns: one vacancy that comes back under new ids or other sources.

A vacancy is a company and the shape of a title: its words in lower case, without
figures, punctuation and what stands in brackets. Over the runs that saw it, its
presence falls into islands; a gap is the runs between two of them that did not.
A vacancy that returned after a gap with an id never seen before was reposted; one
seen at several sources under several ids was spread.

Sightings are summed up per vacancy and run, and per vacancy and id, before any
window, so a company of a third of all listings brings one row a run to its
window. Runs are few; their order is broadcast. Sightings without company, id or
run, and titles without a letter, are left out. Repeated sightings count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VACANCY = ["company", "shape"]


def title_shape(title: Column) -> Column:
    """The words of a title that tell one vacancy from another; null without any."""
    bare = F.regexp_replace(F.lower(title), r"\([^)]*\)|\[[^\]]*\]", " ")
    words = F.trim(F.regexp_replace(bare, r"[^\p{L}]+", " "))
    return F.nullif(words, F.lit(""))


def islands(sightings: DataFrame) -> DataFrame:
    """``company, shape, run, place, missed, island, n_new``: a row for each run that
    saw a vacancy, the runs missed before it, and ids first seen in it."""
    seen = sightings.select(F.lower(F.trim("company")).alias("company"), title_shape(F.col("title")).alias("shape"), "id", "run", "source")
    seen = seen.filter("company <> '' AND shape IS NOT NULL AND id IS NOT NULL AND run IS NOT NULL")
    # One row a run: as many as runs were ever made.
    order = F.row_number().over(Window.orderBy("run"))
    runs = sightings.filter("run IS NOT NULL").groupBy("run").agg(F.lit(1).alias("one")).select("run", order.alias("place"))
    first = seen.groupBy(*VACANCY, "id").agg(F.min("run").alias("run")).groupBy(*VACANCY, "run").agg(F.count("*").alias("n_new"))
    present = seen.groupBy(*VACANCY, "run").agg(F.lit(1).alias("one")).drop("one")
    placed = present.join(F.broadcast(runs), "run").join(first, [*VACANCY, "run"], "left")
    along = Window.partitionBy(*VACANCY).orderBy("place")
    missed = F.coalesce(F.col("place") - F.lag("place").over(along) - 1, F.lit(0))
    gaps = placed.withColumn("missed", missed)
    return gaps.withColumn("island", F.sum((F.col("missed") > 0).cast("int")).over(along)).fillna({"n_new": 0})


def repost_patterns(sightings: DataFrame) -> DataFrame:
    """Vacancies that were reposted or spread, with their runs, gaps, ids and sources.

    ``sightings`` hold ``id, company, title, source, run``, one row for each run
    that saw a listing.
    """
    history = islands(sightings).groupBy(*VACANCY).agg(
        F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.count("*").alias("n_runs"), (F.max("island") + 1).alias("n_posts"),
        F.max("missed").cast("long").alias("longest_gap"), F.sum(F.when(F.col("island") > 0, F.col("n_new")).otherwise(0)).alias("n_returned_ids"),
    )
    seen = sightings.select(F.lower(F.trim("company")).alias("company"), title_shape(F.col("title")).alias("shape"), "id", "source").filter("id IS NOT NULL AND company <> '' AND shape IS NOT NULL")
    ids = seen.groupBy(*VACANCY, "id").agg(F.lit(1).alias("one")).groupBy(*VACANCY).agg(F.count("*").alias("n_ids"))
    sources = seen.filter("source IS NOT NULL").groupBy(*VACANCY, "source").agg(F.lit(1).alias("one")).groupBy(*VACANCY).agg(F.count("*").alias("n_sources"))
    joined = history.join(ids, VACANCY).join(sources, VACANCY, "left").fillna({"n_sources": 0})
    reposted = (F.col("n_posts") > 1) & (F.col("n_returned_ids") > 0)
    spread = (F.col("n_sources") > 1) & (F.col("n_ids") > 1)
    pattern = F.when(reposted & spread, F.lit("reposted_and_spread")).when(reposted, F.lit("reposted")).when(spread, F.lit("spread"))
    return joined.withColumn("pattern", pattern).filter(F.col("pattern").isNotNull())
