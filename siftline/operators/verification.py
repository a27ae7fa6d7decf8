"""Legitimacy from the text, liveness from landed page fetches, and both together."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.dates import timestamp_literal
from siftline.functions.patterns import quote, sql_string
from siftline.functions.text import searchable_text
from siftline.operators.once import compute_once
from siftline.schema import VERIFICATION

# --- Fixed values: signals (id, pattern, weight, reason), thresholds, phrases ---
SIGNALS = (
    (
        "fee.upfront",
        r"\b(?:registration|processing|application|training|onboarding)\s+fee\b",
        3,
        "Asks for an upfront fee — legitimate employers never charge candidates",
    ),
    (
        "fee.deposit",
        r"\b(?:security\s+deposit|refundable\s+deposit|pay\s+a\s+deposit)\b",
        3,
        "Requires a deposit from the candidate",
    ),
    (
        "fee.equipment",
        r"\bpurchase\s+(?:your\s+own\s+)?(?:equipment|software|laptop)\s+(?:upfront|in\s+advance|from\s+us)\b",
        3,
        "Requires buying equipment from the employer up front",
    ),
    (
        "contact.messaging_app",
        r"\b(?:contact|message|reach|apply|interview)\w*\s+(?:us\s+|me\s+)?(?:on|via|through)\s+(?:telegram|whatsapp|signal)\b",
        3,
        "Directs applicants to an off-platform messaging app",
    ),
    (
        "contact.telegram_handle",
        r"(?:t\.me/|@[a-z0-9_]{5,32}\s+on\s+telegram)",
        2,
        "Contains a Telegram handle",
    ),
    (
        "pay.crypto",
        r"\b(?:paid|payment|salary|compensation)\s+(?:in|via)\s+(?:bitcoin|btc|usdt|crypto|cryptocurrency|ethereum)\b",
        2,
        "Offers payment in cryptocurrency",
    ),
    (
        "cred.bank_details",
        r"\b(?:bank\s+account|routing\s+number|card\s+details?)\s+(?:required|needed|to\s+start|for\s+verification)\b",
        3,
        "Requests banking details as part of applying",
    ),
    (
        "claim.no_experience_high_pay",
        r"\bno\s+experience\s+(?:required|necessary|needed)\b",
        2,
        "Claims no experience is required",
    ),
    (
        "claim.guaranteed",
        r"\b(?:guaranteed|immediate)\s+(?:income|earnings|hire|placement)\b",
        2,
        "Guarantees income or placement",
    ),
    (
        "claim.weekly_earnings",
        r"\bearn\s+(?:up\s+to\s+)?\$?\d[\d,]*\s*(?:\+)?\s*(?:per|a|/)\s*(?:week|day)\b",
        2,
        "Advertises headline weekly or daily earnings",
    ),
    (
        "contact.personal_email",
        r"\b(?:send|email)\s+(?:your\s+)?(?:cv|resume|details)\s+to\s+[\w.+-]+@(?:gmail|yahoo|hotmail|outlook|aol)\.com\b",
        2,
        "Applications go to a free personal email address",
    ),
)
SCAM_SCORE = 3
SUSPICIOUS_SCORE = 2
CLOSED_PHRASES = (
    "this position has been filled",
    "this job has been filled",
    "no longer accepting applications",
    "no longer available",
    "this posting has expired",
    "this job is closed",
    "position closed",
    "applications are closed",
    "we are no longer hiring for this role",
    "job not found",
    "this role has been filled",
)
GONE_STATUSES = (404, 410)
CLOSED_REASON = "Listing page says the position is no longer open"
# --- End of fixed values --------------------------------------------------------

# For each signal, words of which one must occur wherever its pattern matches.
# Looking for a word costs a fraction of running a pattern.
REQUIRED_WORDS = {
    "fee.upfront": ("fee",),
    "fee.deposit": ("deposit",),
    "fee.equipment": ("purchase",),
    "contact.messaging_app": ("telegram", "whatsapp", "signal"),
    "contact.telegram_handle": ("t.me/", "telegram"),
    "pay.crypto": ("bitcoin", "btc", "usdt", "crypto", "ethereum"),
    "cred.bank_details": ("account", "routing", "card"),
    "claim.no_experience_high_pay": ("experience",),
    "claim.guaranteed": ("guaranteed", "immediate"),
    "claim.weekly_earnings": ("earn",),
    "contact.personal_email": ("@gmail", "@yahoo", "@hotmail", "@outlook", "@aol"),
}


def scam_signals(text: str, folded: str) -> Column:
    """Triggered signals in declared order, as ``array<struct>``.

    ``folded`` names a column with the lower-case text.
    """
    each = []
    for name, pattern, weight, reason in SIGNALS:
        words = " OR ".join(f"contains({folded}, {sql_string(w)})" for w in REQUIRED_WORDS[name])
        each.append(
            f"CASE WHEN ({words}) AND {text} RLIKE {sql_string('(?iU)' + pattern)} THEN "
            f"named_struct('id', {sql_string(name)}, 'weight', {weight}, 'reason', {sql_string(reason)}) END"
        )
    return F.expr(f"array_compact(array({', '.join(each)}))")


def legitimacy(signals: Column) -> Column:
    """Verification struct from the triggered signals: weights add up."""
    score = F.aggregate(signals, F.lit(0), lambda total, s: total + s["weight"])
    return _result(
        F.when(score >= SCAM_SCORE, F.lit("scam")).when(score >= SUSPICIOUS_SCORE, F.lit("suspicious")).otherwise(F.lit("ok")),
        F.transform(signals, lambda s: s["reason"]),
    )


def _result(tier: Column, reasons: Column, checked_at: Column | None = None, status: Column | None = None) -> Column:
    return F.struct(
        tier.alias("tier"),
        reasons.alias("reasons"),
        (F.lit(None) if checked_at is None else checked_at).alias("checked_at"),
        (F.lit(None) if status is None else status).alias("http_status"),
    ).cast(VERIFICATION)


def with_signals(listings: DataFrame, name: str = "signals") -> DataFrame:
    texts = listings.withColumn("_text", searchable_text()).withColumn("_folded", F.lower("_text"))
    return compute_once(texts, {name: scam_signals("_text", "_folded")}).drop("_text", "_folded")


def assess_legitimacy(listings: DataFrame, name: str = "legitimacy") -> DataFrame:
    return with_signals(listings, "_signals").withColumn(name, legitimacy(F.col("_signals"))).drop("_signals")


def looks_closed(page_text: Column) -> Column:
    return page_text.rlike("(?iU)" + "|".join(quote(p) for p in CLOSED_PHRASES))


def classify_liveness(fetches: DataFrame, name: str = "liveness", body_chars: int | None = None) -> DataFrame:
    """Verification struct of each landed fetch (``http_status``,
    ``content_type``, ``body``, ``error``).

    A failed fetch says nothing about the listing. The whole body is searched
    unless ``body_chars`` sets a limit.
    """
    status = F.col("http_status").cast("int")
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    body = F.col("body") if body_chars is None else F.substring(F.col("body"), 1, body_chars)
    closed = (kind.contains("html") | kind.contains("text")) & F.coalesce(looks_closed(body), F.lit(False))
    nothing = F.array().cast("array<string>")
    outcome = (
        F.when(F.col("error").isNotNull(), _result(F.lit("unknown"), F.array(F.concat(F.lit("Could not reach the listing: "), F.col("error")))))
        .when(
            status.isin(*GONE_STATUSES),
            _result(F.lit("expired"), F.array(F.concat(F.lit("Listing page returns HTTP "), status.cast("string"))), status=status),
        )
        .when(closed, _result(F.lit("expired"), F.array(F.lit(CLOSED_REASON)), status=status))
        .otherwise(_result(F.lit("ok"), nothing, status=status))
    )
    return fetches.withColumn(name, outcome)


def combine_verification(legit: Column, live: Column, now: datetime) -> Column:
    """Scam text settles it; otherwise the worse of both, with all reasons.

    A listing without a landed fetch (``live`` null) counts as unreachable.
    """
    checked = timestamp_literal(now)
    tier = (
        F.when(live["tier"] == "expired", F.lit("expired"))
        .when(legit["tier"] == "suspicious", F.lit("suspicious"))
        .when(live.isNull() | (live["tier"] == "unknown"), F.lit("unknown"))
        .otherwise(F.lit("ok"))
    )
    reasons = F.concat(legit["reasons"], F.coalesce(live["reasons"], F.array(F.lit("Could not reach the listing: no fetch landed"))))
    return F.when(legit["tier"] == "scam", _result(F.lit("scam"), legit["reasons"], checked)).otherwise(
        _result(tier, reasons, checked, live["http_status"])
    )


def verify(pending: DataFrame, fetches: DataFrame, now: datetime, on: str = "id") -> DataFrame:
    """``(id, verification)`` of the pending listings.

    Scams are settled from their text and never meet the page bodies: fetches
    are joined to the rest only, and narrowed to their verdict before the join.
    """
    assessed = assess_legitimacy(pending).select("id", *([on] if on != "id" else []), "legitimacy")
    live = classify_liveness(fetches).select(on, "liveness")
    joined = assessed.join(live, on, "left")
    return joined.select("id", combine_verification(F.col("legitimacy"), F.col("liveness"), now).alias("verification"))


def verify_pending(
    view: DataFrame, limit: int | None = None, order: Sequence[Column] | None = None, recheck_unknown: bool = False
) -> DataFrame:
    """Listings without a verification: all of them, or with a fetch budget the
    first ``limit`` in listing order. A stored ``unknown`` tier counts as verified
    unless ``recheck_unknown`` asks for another look.
    """
    from siftline.operators.views import order_columns

    due = F.col("verification").isNull()
    if recheck_unknown:
        due = due | (F.col("verification.tier") == "unknown")
    pending = view.filter(due)
    if limit is None:
        return pending
    return pending.orderBy(*(order or order_columns("match_score"))).limit(limit)
