"""Posting dates in the shapes feeds use. Anything else is null."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import literal, lookup, strip
from siftline.schema import utc

# --- Fixed values: units, epoch limits, zone names ---
UNIT_SECONDS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400,
    "week": 604800, "month": 30 * 86400, "year": 365 * 86400,
}
LAST_EPOCH_SECOND = 4102444800  # 2100-01-01; a larger number counts milliseconds
MIN_EPOCH_DIGITS = 9
MAX_SECONDS = 253402300799  # 9999-12-31
MIN_SECONDS = -62135596800  # 0001-01-01
ZONES = {
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AST": "-04:00", "ADT": "-03:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# --- End of fixed values -----------------------------

_AGO = r"(?iU)([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s*ago"
_ISO = (
    r"(?s)\A(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:([+-]\d{2}):?(\d{2})?(?::?\d{2})?)?)?\z"
)
_RFC = (
    r"(?i)\A(?:[a-z]{3,9},?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{2}|\d{4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]+).*)?\z"
)


def micros(now: datetime) -> int:
    moment = utc(now)
    return int(moment.timestamp()) * 1_000_000 + moment.microsecond


def timestamp_literal(now: datetime) -> Column:
    return F.timestamp_micros(F.lit(micros(now)))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _relative(text: Column, now: datetime) -> Column:
    count = F.regexp_extract(text, _AGO, 1).try_cast("bigint")
    unit = lookup(F.lower(F.regexp_extract(text, _AGO, 2)), UNIT_SECONDS, "bigint")
    back = F.try_multiply(count, unit)
    # Nothing before year 1 is a date.
    limit = micros(now) // 1_000_000 - MIN_SECONDS
    return F.when(back <= limit, F.timestamp_micros(F.lit(micros(now)) - back * 1_000_000))


def _epoch(text: Column) -> Column:
    value = text.try_cast("bigint")
    millis = value > LAST_EPOCH_SECOND
    whole = F.when(millis, F.call_function("div", value, F.lit(1000))).otherwise(value)
    return F.when(whole <= MAX_SECONDS, F.timestamp_seconds(whole))


def _iso(text: Column) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(text, _ISO, group)

    stamp = F.concat(
        part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit("T"),
        _or(part(5), "00"), F.lit(":"), _or(part(6), "00"), F.lit(":"), _or(part(7), "00"), F.lit("."),
        _or(F.substring(part(8), 1, 6), "0"), _or(part(9), "+00"), F.lit(":"), _or(part(10), "00"),
    )
    return stamp.try_cast("timestamp")


def _rfc2822(text: Column) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC, group)

    month = F.array_position(literal(MONTHS, "array<string>"), F.lower(part(2)))
    year = part(3)
    # Two-digit years pivot at 69.
    full_year = F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year < "69", F.lit("20")).otherwise(F.lit("19")), year)
    )
    zone = part(7)
    offset = F.when(
        zone.rlike(r"\A[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
    ).otherwise(F.coalesce(lookup(F.upper(zone), ZONES), F.lit("+00:00")))
    stamp = F.concat(
        full_year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"),
        F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), _or(part(6), "00"), offset,
    )
    return stamp.try_cast("timestamp")


def parse_posted_at(value: Column, now: datetime) -> Column:
    """A UTC timestamp from relative, epoch, ISO 8601 or RFC 2822 text.

    Each branch is entered only for text of its own shape: a bare cast would
    also accept words such as ``yesterday``.
    """
    text = strip(value)
    iso_text = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return (
        F.when(text.rlike(_AGO), _relative(text, now))
        .when(text.rlike(rf"\A[0-9]{{{MIN_EPOCH_DIGITS},}}\z"), _epoch(text))
        .when(iso_text.rlike(_ISO), _iso(iso_text))
        .when(text.rlike(_RFC), _rfc2822(text))
    )


def relative_days(posted: Column, now: datetime) -> Column:
    """``today``, ``yesterday``, ``5d ago`` or ``2mo ago``."""
    age = F.floor((F.lit(micros(now)) - F.unix_micros(posted)) / 86_400_000_000)
    return (
        F.when(age <= 0, F.lit("today"))
        .when(age == 1, F.lit("yesterday"))
        .when(age < 30, F.concat(age.cast("string"), F.lit("d ago")))
        .when(age.isNotNull(), F.concat(F.floor(age / 30).cast("string"), F.lit("mo ago")))
    )
