"""Filtering with a reason for every drop.

Checks run cheapest first and the first failure is the reported reason, so drop
counts add up like a funnel. A missing value never fails a check.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.dates import timestamp_literal
from siftline.functions.patterns import quote
from siftline.functions.pay import approx_hourly_usd
from siftline.functions.text import searchable_text
from siftline.operators.eligibility import effective_eligibility
from siftline.schema import Criteria, utc

# The reported reasons, in the order the checks run.
DROP_REASONS = (
    "status_dismissed",
    "ineligible",
    "unknown_eligibility",
    "verification",
    "title_excluded",
    "title_not_matched",
    "too_old",
    "contract_type",
    "below_min_rate",
    "no_signal",
)


def matches_any(text: Column, phrases: Sequence[str]) -> Column:
    """Case-blind substring test, as opposed to whole words."""
    lowered = F.lower(text)
    result = F.lit(False)
    for phrase in phrases:
        result = result | lowered.contains(phrase.lower())
    return result


def has_tech_signal(text: Column, keywords: Sequence[str]) -> Column:
    """One of the keywords occurs as a whole word; no keywords means yes.

    The substring test is exact as a precondition and far cheaper than the
    pattern, which then runs on promising rows only.
    """
    if not keywords:
        return F.lit(True)
    lowered = F.lower(text)
    result = F.lit(False)
    for keyword in keywords:
        word = keyword.lower()
        result = result | (lowered.contains(word) & lowered.rlike(rf"(?U)\b{quote(word)}\b"))
    return result


def checks(criteria: Criteria, now: datetime) -> dict[str, Column]:
    """Failure condition per reason, for the checks the criteria turn on."""
    outcome = effective_eligibility(F.col("eligibility_override"), F.col("eligibility"))
    failing: dict[str, Column] = {}
    if not criteria.include_dismissed:
        failing["status_dismissed"] = F.col("status") == "dismissed"
    if criteria.exclude_ineligible:
        failing["ineligible"] = outcome == "ineligible"
    if criteria.exclude_unknown_eligibility:
        failing["unknown_eligibility"] = outcome == "unknown"
    if criteria.excluded_tiers:
        failing["verification"] = F.col("verification.tier").isin(*criteria.excluded_tiers)
    if criteria.excluded_title_phrases:
        failing["title_excluded"] = matches_any(F.col("title"), criteria.excluded_title_phrases)
    if criteria.required_title_phrases:
        failing["title_not_matched"] = ~matches_any(F.col("title"), criteria.required_title_phrases)
    if criteria.max_age_days is not None:
        cutoff = timestamp_literal(utc(now) - timedelta(days=criteria.max_age_days))
        failing["too_old"] = F.col("posted_at") < cutoff
    if criteria.contract_types:
        kind = F.col("contract_type")
        failing["contract_type"] = (kind != "unknown") & ~kind.isin(*criteria.contract_types)
    if criteria.min_hourly_rate_usd is not None:
        floor = F.lit(float(criteria.min_hourly_rate_usd))
        failing["below_min_rate"] = approx_hourly_usd(F.col("compensation")) < floor
    if criteria.require_tech_signal and criteria.tech_keywords:
        failing["no_signal"] = ~has_tech_signal(searchable_text(), criteria.tech_keywords)
    return failing


def first_failure(criteria: Criteria, now: datetime) -> Column:
    """The first failing reason, or null for a row that is kept."""
    failing = checks(criteria, now)
    if not failing:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(failing[r], F.lit(r)) for r in DROP_REASONS if r in failing])


def apply_filters(view: DataFrame, criteria: Criteria, now: datetime) -> DataFrame:
    """Add ``drop_reason``; null marks the kept rows. No row is removed."""
    return view.withColumn("drop_reason", first_failure(criteria, now))


def kept(view: DataFrame, criteria: Criteria, now: datetime) -> DataFrame:
    """The survivors. The reason is tested in the filter and not carried along,
    so the text checks run once per row."""
    return view.filter(first_failure(criteria, now).isNull())


def drop_counts(filtered: DataFrame) -> DataFrame:
    dropped = filtered.select("drop_reason").filter(F.col("drop_reason").isNotNull())
    return dropped.groupBy("drop_reason").agg(F.count("*").alias("n"))
