"""Named predicates: rule conditions that are computed, not phrased.

Each builds a Column holding the evidence text, or null where it cannot decide.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import clocks
from siftline.functions.text import bind, lookup
from siftline.schema import Profile


def available_hours(profile: Profile, now: datetime) -> dict[str, float]:
    """Shared work hours per abbreviation, worked out once on the driver."""
    mine = clocks.utc_offset_hours(profile.timezone, now)
    if mine is None:
        return {}
    start, end = clocks.WORKDAY
    hours = {}
    for name, zone in clocks.ABBREVIATIONS.items():
        theirs = clocks.utc_offset_hours(zone, now)
        # Two days of equal length: every hour apart is an hour lost, and the
        # gap wraps at midnight.
        gap = abs(mine - theirs) % 24
        hours[name] = max(0.0, (end - start) - min(gap, 24 - gap))
    return hours


def insufficient_overlap(text: Column, profile: Profile, now: datetime) -> Column:
    """Fires when the stated overlap exceeds what the two workdays share.

    No stated hours, no zone nearby or an unknown user zone: no verdict.
    """
    return bind(stated_overlap(text), lambda stated: insufficient(stated, profile, now))


def insufficient(stated: Column, profile: Profile, now: datetime) -> Column:
    """The same from a requirement that is already parsed."""
    hours = available_hours(profile, now)
    if not hours:
        return F.lit(None).cast("string")
    zone, required = stated["zone"], stated["hours"].cast("int")
    said = F.concat(
        F.lit("Requires "), required.cast("string"), F.lit("h overlap with "), F.upper(zone),
        F.lit(f"; your timezone ({profile.timezone}) gives about "),
        lookup(zone, {k: f"{v:.1f}" for k, v in hours.items()}),
        F.lit("h of standard working-hour overlap"),
    )
    return F.when(lookup(zone, hours, "double") < required, said)


def stated_overlap(text: Column) -> Column:
    """``struct<hours, zone>``: what a text asks for, whoever reads it."""
    return F.struct(clocks.required_hours(text).alias("hours"), clocks.stated_zone(text).alias("zone"))


def sufficient_overlap(text: Column, profile: Profile, now: datetime) -> Column:
    """Hours are stated and the opposite predicate is silent.

    That includes hours stated for a zone nobody recognises.
    """
    return bind(stated_overlap(text), lambda stated: sufficient(stated, profile, now))


def sufficient(stated: Column, profile: Profile, now: datetime) -> Column:
    """The same from a requirement that is already parsed."""
    available = available_hours(profile, now)
    said = F.concat(F.lit("Stated overlap requirement of "), stated["hours"], F.lit("h is satisfiable"))
    if not available:
        return said
    short = lookup(stated["zone"], available, "double") < stated["hours"].cast("int")
    return F.when(~F.coalesce(short, F.lit(False)), said)


def contract_mismatch(profile: Profile, contract_type: Column | None = None) -> Column:
    """The listing's known contract type is none the user wants."""
    wanted = profile.contract_types
    if not wanted:
        return F.lit(None).cast("string")
    actual = F.col("contract_type") if contract_type is None else contract_type
    accepted = ", ".join(w.replace("_", " ") for w in wanted)
    return F.when(
        (actual != "unknown") & ~actual.isin(*wanted),
        F.concat(F.lit("Listing is "), F.replace(actual, F.lit("_"), F.lit(" ")), F.lit(f"; you accept {accepted}")),
    )


def unsupported_currency(profile: Profile, currency: Column | None = None) -> Column:
    """Pay is quoted in a currency the user did not accept."""
    wanted = sorted({c.upper() for c in profile.currencies})
    if not wanted:
        return F.lit(None).cast("string")
    actual = F.upper(F.col("compensation.currency") if currency is None else currency)
    return F.when(
        (actual != "") & ~actual.isin(*wanted),
        F.concat(F.lit("Pay quoted in "), actual, F.lit(f"; you accept {', '.join(wanted)}")),
    )


PREDICATES: dict[str, Callable[[Column, Profile, datetime], Column]] = {
    "timezone.insufficient_overlap": insufficient_overlap,
    "timezone.sufficient_overlap": sufficient_overlap,
    "contract.type_mismatch": lambda text, profile, now: contract_mismatch(profile),
    "currency.unsupported": lambda text, profile, now: unsupported_currency(profile),
}
