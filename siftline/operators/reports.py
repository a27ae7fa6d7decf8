"""Counts over the curated data, the stage funnel and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.views import effective


def stats(view: DataFrame) -> DataFrame:
    """``(facet, value, n)`` for the total, each eligibility, status and source,
    and the scored and verified rows, in one pass over the data."""
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"), F.lit(1).alias("hit")),
        F.struct(F.lit("eligibility").alias("facet"), effective().alias("value"), F.lit(1).alias("hit")),
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("value"), F.lit(1).alias("hit")),
        F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"), F.lit(1).alias("hit")),
        F.struct(F.lit("scored").alias("facet"), F.lit("").alias("value"), F.col("match").isNotNull().cast("int").alias("hit")),
        F.struct(F.lit("verified").alias("facet"), F.lit("").alias("value"), F.col("verification").isNotNull().cast("int").alias("hit")),
    )
    return view.select(F.inline(facets)).groupBy("facet", "value").agg(F.sum("hit").cast("bigint").alias("n"))


def collect_counts(normalised: DataFrame) -> DataFrame:
    """Fetched against unique listings, both from one aggregation."""
    return normalised.agg(F.count("*").alias("fetched"), F.count_distinct("id").alias("unique"))


def source_spans(entries: DataFrame, landed: str = "landed_at") -> DataFrame:
    """``(source, seconds)``: from a source's first landed response to its last."""
    at = F.unix_micros(landed)
    return entries.groupBy("source").agg(((F.max(at) - F.min(at)) / 1_000_000).alias("seconds"))


def source_outcomes(configured: DataFrame, fetched: DataFrame, errors: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """One row per configured source: rows fetched, failed payloads, error, state,
    and with ``spans`` the ``seconds`` its landing took (null without a response).

    No rows without an error is its own state, because a broken parser looks
    exactly like that. ``configured`` is ``(source, source_priority)`` and
    ``errors`` is ``(source, failed_payloads, error)``.
    """
    counts = fetched.groupBy("source").agg(F.count("*").alias("fetched"))
    joined = configured.join(counts, "source", "left").join(errors.select("source", "failed_payloads", "error"), "source", "left")
    rows, failed = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("fetched", "failed_payloads"))
    state = F.when(F.col("error").isNotNull(), F.lit("error")).when(rows == 0, F.lit("empty")).otherwise(F.lit("ok"))
    named = joined.select("source", "source_priority", rows.alias("fetched"), failed.alias("failed_payloads"), "error", state.alias("state"))
    return named if spans is None else named.join(spans.select("source", "seconds"), "source", "left")


def source_health(source_runs: DataFrame, order: str = "run_id") -> DataFrame:
    """Each run of each source, and whether it is the second empty one running.

    ``source_runs`` is ``(run_id, source, fetched)``: one row per source and run.
    """
    history = Window.partitionBy("source").orderBy(order)
    broken = (F.col("fetched") == 0) & (F.lag("fetched").over(history) == 0)
    return source_runs.withColumn("broken", F.coalesce(broken, F.lit(False)))


#: Counters of a run, in stage order.
STAGES = ("fetched", "normalised", "deduplicated", "eligible", "ineligible", "unknown", "filtered_out", "verified", "scored", "errors")


def funnel_report(
    *,
    fetched: DataFrame,
    normalised: DataFrame,
    deduplicated: DataFrame,
    verdicts: DataFrame,
    drops: DataFrame,
    verified: DataFrame,
    scored: DataFrame,
    errors: DataFrame | None = None,
) -> DataFrame:
    """``(stage, n)``: what each stage of one run let through, each counted at
    that stage.

    ``verdicts`` has an ``outcome``, ``drops`` a ``drop_reason``; ``errors`` holds
    the failed sources.
    """

    def counted(name: str, rows: DataFrame | None) -> DataFrame:
        source = fetched.limit(0) if rows is None else rows
        return source.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))

    judged = verdicts.agg(*[F.count_if(F.col("outcome") == e).alias(e) for e in ("eligible", "ineligible", "unknown")])
    parts = [
        counted("fetched", fetched),
        counted("normalised", normalised),
        counted("deduplicated", deduplicated),
        judged.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in judged.columns]))),
        counted("filtered_out", drops.filter(F.col("drop_reason").isNotNull())),
        counted("verified", verified),
        counted("scored", scored),
        counted("errors", errors),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
