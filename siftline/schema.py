"""Row schemas, checked value domains and the small driver-side settings.

Profiles, criteria and rules are configuration: a handful of values that shape
a plan. They stay frozen dataclasses on the driver and are compiled to literals,
so the executors only ever see built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import types as T

# --- Fixed values: the stored value domains -------------------------------
ELIGIBLE, INELIGIBLE, UNKNOWN = "eligible", "ineligible", "unknown"
ELIGIBILITY = ("eligible", "ineligible", "unknown")
DIMENSIONS = ("location", "timezone", "authorisation", "contract", "currency")
TIERS = ("ok", "suspicious", "scam", "expired", "unknown")
CONTRACT_TYPES = ("full_time", "part_time", "contract", "internship", "unknown")
PERIODS = ("hourly", "daily", "monthly", "yearly")
STATUSES = ("new", "shortlisted", "applied", "rejected", "dismissed")
SEARCHABLE_FIELDS = ("title", "company", "location_text", "description")
USER_FIELDS = ("status", "notes", "eligibility_override")
# Columns a new scrape may refresh on a row that already exists. ``id``,
# ``source``, ``url`` and ``first_seen_at`` stay as first stored, and the user's
# columns live in another table altogether.
REFRESHABLE = (
    "external_id",
    "title",
    "company",
    "description",
    "location_text",
    "compensation",
    "contract_type",
    "tags",
    "posted_at",
    "last_seen_at",
    "content_hash",
)
# --- End of fixed values --------------------------------------------------

MONEY = T.DecimalType(20, 4)

COMPENSATION = T.StructType(
    [
        T.StructField("minimum", MONEY),
        T.StructField("maximum", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)

RAW_LISTING = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location_text", T.StringType()),
        T.StructField("compensation_text", T.StringType()),
        T.StructField("contract_text", T.StringType()),
        T.StructField("posted_at_text", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location_text", T.StringType()),
        T.StructField("compensation", COMPENSATION),
        T.StructField("contract_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

DIMENSION_VERDICT = T.StructType(
    [
        T.StructField("dimension", T.StringType()),
        T.StructField("eligibility", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("matched_text", T.StringType()),
        T.StructField("source_field", T.StringType()),
    ]
)

ELIGIBILITY_VERDICT = T.StructType(
    [
        T.StructField("eligibility", T.StringType()),
        T.StructField("dimensions", T.ArrayType(DIMENSION_VERDICT)),
    ]
)

VERIFICATION = T.StructType(
    [
        T.StructField("tier", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("checked_at", T.TimestampType()),
        T.StructField("http_status", T.IntegerType()),
    ]
)

MATCH = T.StructType(
    [
        T.StructField("score", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("gaps", T.ArrayType(T.StringType())),
        T.StructField("provider", T.StringType()),
        T.StructField("scored_at", T.TimestampType()),
    ]
)

USER_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def utc(value: datetime) -> datetime:
    """An aware UTC datetime; a naive one is read as UTC."""
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


@dataclass(frozen=True)
class Profile:
    """What the user declares about themselves. Nothing here is inferred."""

    country: str
    timezone: str = "UTC"
    country_name: str | None = None
    work_authorisation: tuple[str, ...] = ()
    contract_types: tuple[str, ...] = ()
    currencies: tuple[str, ...] = ()
    min_hourly_rate_usd: Decimal | None = None
    skills: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    seniority: str | None = None
    resume_text: str = ""

    @property
    def has_resume(self) -> bool:
        return bool(self.resume_text.strip())


@dataclass(frozen=True)
class Criteria:
    """What the user wants to see; the defaults hide as little as possible."""

    # The default title phrases.
    DEFAULT_EXCLUDED_TITLES = (
        "recruiter",
        "sales",
        "account executive",
        "business development",
        "marketing",
        "customer success",
        "support engineer",
        "solutions architect",
        "engineering manager",
        "director",
        "vp ",
        "vice president",
        "head of",
        "intern",
        "internship",
        "teacher",
        "instructor",
        "tutor",
    )

    exclude_ineligible: bool = True
    exclude_unknown_eligibility: bool = False
    excluded_tiers: tuple[str, ...] = ("scam", "expired")
    excluded_title_phrases: tuple[str, ...] = DEFAULT_EXCLUDED_TITLES
    required_title_phrases: tuple[str, ...] = ()
    max_age_days: int | None = None
    min_hourly_rate_usd: Decimal | None = None
    contract_types: tuple[str, ...] = ()
    require_tech_signal: bool = True
    tech_keywords: tuple[str, ...] = ()
    include_dismissed: bool = False


@dataclass(frozen=True)
class FilterSettings:
    """The user's filter settings before the profile fills the gaps."""

    exclude_ineligible: bool = True
    exclude_unknown_eligibility: bool = False
    excluded_title_phrases: tuple[str, ...] = ()
    required_title_phrases: tuple[str, ...] = ()
    max_age_days: int | None = None
    min_hourly_rate_usd: Decimal | None = None
    require_tech_signal: bool = True


def criteria_from_profile(profile: Profile, settings: FilterSettings | None = None) -> Criteria:
    """Settings first, then the profile, then the permissive defaults.

    A non-empty list of excluded title phrases replaces the default list.
    """
    chosen = settings or FilterSettings()
    floor = chosen.min_hourly_rate_usd
    return Criteria(
        exclude_ineligible=chosen.exclude_ineligible,
        exclude_unknown_eligibility=chosen.exclude_unknown_eligibility,
        excluded_title_phrases=chosen.excluded_title_phrases or Criteria.DEFAULT_EXCLUDED_TITLES,
        required_title_phrases=chosen.required_title_phrases,
        max_age_days=chosen.max_age_days,
        min_hourly_rate_usd=profile.min_hourly_rate_usd if floor is None else floor,
        contract_types=profile.contract_types,
        require_tech_signal=chosen.require_tech_signal,
        tech_keywords=profile.skills,
    )
