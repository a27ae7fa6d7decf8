"""Implausible pay: listings whose lowest figure lies far outside its market.

A market is a currency, a pay period and a contract type. Each run leaves one
quantile sketch per market; sketches of any number of runs merge, so bounds follow
the whole history without reading it again. A figure is implausible outside the
quartiles stretched by ``SPREAD`` of their ratio, as pay spreads by factors.

A sketch of up to ``SKETCH`` figures is exact; a larger one's quartiles are off by
0.1 % of the ranks or so. Listings without a figure, currency or period, and
figures of zero, belong to no market. Markets of fewer than ``LEAST`` figures have
no bounds and flag nothing. Repeated listings count as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKET = ("currency", "period", "contract_type")
SKETCH = 4096
SPREAD = 1.5
LEAST = 20


def priced(listings: DataFrame) -> DataFrame:
    """``id``, market and ``figure`` of the listings that state one."""
    pay = F.col("compensation")
    rows = listings.select(
        "id", F.upper(pay["currency"]).alias("currency"), pay["period"].alias("period"),
        F.coalesce("contract_type", F.lit("unknown")).alias("contract_type"), pay["minimum"].cast("double").alias("figure"),
    )
    return rows.filter("figure > 0 AND currency IS NOT NULL AND period IS NOT NULL")


def rate_sketches(listings: DataFrame) -> DataFrame:
    """One mergeable sketch per market; a hot market is combined in every task."""
    return priced(listings).groupBy(*MARKET).agg(F.kll_sketch_agg_double("figure", F.lit(SKETCH)).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of several runs as one per market."""
    return sketches.groupBy(*MARKET).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))


def rate_bounds(sketches: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """Quartiles and bounds of every market, a row each."""
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    told = sketches.select(*MARKET, F.kll_sketch_get_n_double("sketch").alias("n"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    fence = F.pow(F.col("q3") / F.col("q1"), F.lit(spread))
    known = F.col("n") >= least
    return told.withColumns({"low": F.when(known, F.col("q1") / fence), "high": F.when(known, F.col("q3") * fence)})


def implausible_rates(listings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Flagged ids with market, figure, bounds and which of them is broken.

    Markets are as many as currencies, periods and contract types combine to, so
    their table is small enough to broadcast.
    """
    limits = F.broadcast(bounds.select(*MARKET, "low", "high"))
    side = F.when(F.col("figure") < F.col("low"), F.lit("rate_low")).when(F.col("figure") > F.col("high"), F.lit("rate_high"))
    return priced(listings).join(limits, list(MARKET)).withColumn("problem", side).filter(F.col("problem").isNotNull())
