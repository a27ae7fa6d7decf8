"""Pay extraction. A figure is either read from the text or left null; it is
never guessed."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import bind, lookup
from siftline.schema import MONEY

# --- Fixed values: symbols, codes, period hints, conversion tables ---
SYMBOLS = {
    "$": "USD", "us$": "USD", "£": "GBP", "€": "EUR", "₹": "INR",
    "c$": "CAD", "a$": "AUD", "s$": "SGD",
}
CODES = ("usd", "gbp", "eur", "inr", "cad", "aud", "sgd")
PERIOD_HINTS = (
    ("hourly", r"\b(?:per\s+hour|/\s*hour|/\s*hr|hourly|an\s+hour)\b"),
    ("daily", r"\b(?:per\s+day|/\s*day|daily|day\s+rate)\b"),
    ("monthly", r"\b(?:per\s+month|/\s*month|monthly|/\s*mo)\b"),
    ("yearly", r"\b(?:per\s+year|/\s*year|annually|annual|per\s+annum|/\s*yr)\b"),
)
AMOUNT = (
    r"(US\$|C\$|A\$|S\$|[$£€₹])?\s*"
    # Lakh grouping has to come before thousands grouping.
    r"(\d{1,2}(?:,\d{2})+,\d{3}|\d{1,3}(?:[,\s]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
    r"(?:\s*([kKmM])(?![A-Za-z]))?"
)
YEARS = (1900, 2100)
SMALLEST_UNMARKED = 1000
HOURLY_BELOW = 2000
APPROX_USD = {
    "USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "SGD": 0.74, "INR": 0.012,
}
PERIOD_HOURS = {"hourly": 1, "daily": 8, "monthly": 160, "yearly": 1920}
# --- End of fixed values ---------------------------------------------

_AMOUNT = "(?U)" + AMOUNT


def _matches(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(group))


def parse_amounts(text: Column) -> Column:
    """All pay figures in the text, as ``array<decimal>``.

    Without a currency symbol or a k/m suffix, a number below 1000 or one that
    looks like a calendar year is not pay.
    """
    figures = F.zip_with(
        _matches(text, 2),
        F.zip_with(_matches(text, 1), _matches(text, 3), lambda s, m: F.struct(s.alias("symbol"), m.alias("suffix"))),
        lambda number, marks: F.struct(
            (
                F.regexp_replace(number, "[, ]", "").try_cast(MONEY)
                * F.when(F.lower(marks["suffix"]) == "k", F.lit(Decimal(1000)))
                .when(F.lower(marks["suffix"]) == "m", F.lit(Decimal(1000000)))
                .otherwise(F.lit(Decimal(1)))
            )
            .try_cast(MONEY)
            .alias("value"),
            ((marks["symbol"] != "") | (marks["suffix"] != "")).alias("marked"),
        ),
    )
    kept = F.filter(
        figures,
        lambda f: (f["value"] > 0)
        & (f["marked"] | ((f["value"] >= SMALLEST_UNMARKED) & ~f["value"].between(*YEARS))),
    )
    return F.transform(kept, lambda f: f["value"])


def parse_currency(text: Column) -> Column:
    """The first symbol beside a number, else the first currency code."""
    symbol = F.get(F.filter(_matches(text, 1), lambda s: s != ""), F.lit(0))
    code = F.nullif(F.upper(F.regexp_extract(text, rf"(?iU)\b({'|'.join(CODES)})\b", 1)), F.lit(""))
    return F.coalesce(lookup(F.lower(symbol), SYMBOLS), code)


def parse_period(text: Column, largest: Column) -> Column:
    """A stated period; without one, small figures are hourly."""
    result = None
    for period, hint in PERIOD_HINTS:
        hit = text.rlike("(?iU)" + hint)
        result = F.when(hit, F.lit(period)) if result is None else result.when(hit, F.lit(period))
    return result.when(largest < HOURLY_BELOW, F.lit("hourly")).otherwise(F.lit("yearly"))


def parse_compensation(text: Column) -> Column:
    """``struct<minimum, maximum, currency, period>``, all null without an amount.

    One figure is a minimum; only several give a maximum.
    """

    def build(amounts: Column) -> Column:
        found = F.coalesce(F.size(amounts) > 0, F.lit(False))
        largest = F.array_max(amounts)
        return F.struct(
            F.array_min(amounts).cast(MONEY).alias("minimum"),
            F.when(F.size(amounts) > 1, largest).cast(MONEY).alias("maximum"),
            F.when(found, parse_currency(text)).alias("currency"),
            F.when(found, parse_period(text, largest)).alias("period"),
        )

    return bind(parse_amounts(text), build)


def approx_hourly_usd(compensation: Column) -> Column:
    """Rough hourly dollars of the minimum, null when any part is unknown."""
    rate = lookup(F.upper(compensation["currency"]), APPROX_USD, "double")
    hours = lookup(compensation["period"], PERIOD_HOURS, "int")
    return compensation["minimum"].cast("double") * rate / hours


def format_compensation(compensation: Column) -> Column:
    """Short display form such as ``USD 90k–120k/year``; null without figures."""
    low, high = compensation["minimum"], compensation["maximum"]

    def short(value: Column) -> Column:
        # Half-up as displayed; whole cents drop their trailing zeros.
        cents = F.regexp_replace(F.round(value, 2).cast("decimal(20,2)").cast("string"), r"\.?0+\z", "")
        return F.when(value >= 1000, F.concat(F.round(value / 1000, 0).cast("bigint").cast("string"), F.lit("k"))).otherwise(
            F.when(value == 0, F.lit("0")).otherwise(cents)
        )

    figures = F.when(
        low.isNotNull() & high.isNotNull() & (low != high), F.concat(short(low), F.lit("–"), short(high))
    ).otherwise(short(F.coalesce(low, high)))
    return F.concat(
        F.coalesce(F.concat(compensation["currency"], F.lit(" ")), F.lit("")),
        figures,
        F.coalesce(F.concat(F.lit("/"), F.regexp_replace(compensation["period"], r"ly\z", "")), F.lit("")),
    )
