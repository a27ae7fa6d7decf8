"""Filters, verification, ranking."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from siftline.functions.text import searchable_text
from siftline.operators import funnel, ranking, reports, verification
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.schema import Criteria, FilterSettings, criteria_from_profile

# Only the check under test, everything else off.
NOTHING = Criteria(
    exclude_ineligible=False,
    excluded_tiers=(),
    excluded_title_phrases=(),
    require_tech_signal=False,
    include_dismissed=True,
)
STRICT = replace(
    L.CRITERIA, exclude_unknown_eligibility=True, required_title_phrases=("engineer", "developer"), max_age_days=60,
    min_hourly_rate_usd=Decimal(30), include_dismissed=False,
)


def _outcome(name: str, criteria: Criteria) -> None:
    @query(name, O.with_(f"SELECT id, drop_reason FROM (SELECT id, {O.drop_reason(criteria)} AS drop_reason FROM curated) WHERE drop_reason IS NOT NULL", "curated"))
    def run(spark, sf):
        marked = funnel.apply_filters(L.curated(spark, sf), criteria, L.NOW)
        return marked.select("id", "drop_reason").filter(F.col("drop_reason").isNotNull())


_outcome("drop_status_dismissed", replace(NOTHING, include_dismissed=False))
_outcome("drop_ineligible", replace(NOTHING, exclude_ineligible=True))
_outcome("drop_unknown_eligibility", replace(NOTHING, exclude_unknown_eligibility=True))
_outcome("drop_title_excluded", replace(NOTHING, excluded_title_phrases=Criteria.DEFAULT_EXCLUDED_TITLES))
_outcome("drop_title_not_matched", replace(NOTHING, required_title_phrases=("Backend", "platform")))
_outcome("drop_too_old", replace(NOTHING, max_age_days=30))
_outcome("drop_contract_type", replace(NOTHING, contract_types=("full_time", "contract")))
_outcome("drop_below_min_rate", replace(NOTHING, min_hourly_rate_usd=Decimal(45)))
_outcome("drop_no_signal", replace(NOTHING, require_tech_signal=True, tech_keywords=L.PROFILE.skills))
_outcome("first_failure", STRICT)

_LEGIT = (
    "SELECT id, list_reduce(list_concat([0], list_transform(signals, lambda s: s.weight)), lambda a, b: a + b) AS score, signals "
    f"FROM (SELECT id, {O.signal_rows('stext')} AS signals FROM listings)"
)
_TIER = "CASE WHEN score >= 3 THEN 'scam' WHEN score >= 2 THEN 'suspicious' ELSE 'ok' END"


@query(
    "drop_verification",
    O.with_(
        f"SELECT id, 'verification' AS drop_reason FROM ({_LEGIT}) WHERE score >= 3",
        "listings",
    ),
)
def drop_verification(spark, sf):
    view = L.curated(spark, sf).drop("verification")
    verified = verification.assess_legitimacy(view, "verification")
    criteria = replace(NOTHING, excluded_tiers=("scam", "expired"))
    return funnel.apply_filters(verified, criteria, L.NOW).select("id", "drop_reason").filter(F.col("drop_reason").isNotNull())


@query("apply_filters", O.with_(f"SELECT id, coalesce({O.drop_reason()}, 'kept') AS outcome FROM curated", "curated"))
def apply_filters(spark, sf):
    marked = funnel.apply_filters(L.curated(spark, sf), L.CRITERIA, L.NOW)
    return marked.select("id", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"))


@query("kept", O.with_(f"SELECT id, title, company FROM curated WHERE ({O.drop_reason()}) IS NULL", "curated"))
def kept(spark, sf):
    return funnel.kept(L.curated(spark, sf), L.CRITERIA, L.NOW).select("id", "title", "company")


@query(
    "drop_counts",
    O.with_(
        f"SELECT drop_reason, count(*) AS n FROM (SELECT {O.drop_reason(STRICT)} AS drop_reason FROM curated) WHERE drop_reason IS NOT NULL GROUP BY drop_reason",
        "curated",
    ),
)
def drop_counts(spark, sf):
    return funnel.drop_counts(funnel.apply_filters(L.curated(spark, sf), STRICT, L.NOW))


_SETTINGS = FilterSettings(excluded_title_phrases=("manager", "designer"), max_age_days=90)
_FROM_PROFILE = criteria_from_profile(replace(L.PROFILE, min_hourly_rate_usd=Decimal(50)), _SETTINGS)


@query(
    "criteria_from_profile",
    O.with_(
        f"SELECT drop_reason, count(*) AS n FROM (SELECT {O.drop_reason(_FROM_PROFILE)} AS drop_reason FROM curated) WHERE drop_reason IS NOT NULL GROUP BY drop_reason",
        "curated",
    ),
)
def from_profile(spark, sf):
    """The user's titles replace the defaults; the profile gives rate and skills."""
    return funnel.drop_counts(funnel.apply_filters(L.curated(spark, sf), _FROM_PROFILE, L.NOW))


# --- verification ---


@query(
    "scam_signals",
    O.with_(
        f"SELECT id, array_to_string(list_transform(signals, lambda s: s.id), ',') AS signal_ids FROM ({_LEGIT}) WHERE len(signals) > 0",
        "listings",
    ),
)
def scam_signals(spark, sf):
    rows = verification.with_signals(L.listings(spark, sf)).filter(F.size("signals") > 0)
    return rows.select("id", F.array_join(F.transform("signals", lambda s: s["id"]), ",").alias("signal_ids"))


@query(
    "assess_legitimacy",
    O.with_(f"SELECT id, {_TIER} AS tier, array_to_string(list_transform(signals, lambda s: s.reason), '; ') AS reasons FROM ({_LEGIT})", "listings"),
)
def assess_legitimacy(spark, sf):
    rows = verification.assess_legitimacy(L.listings(spark, sf))
    return rows.select("id", F.col("legitimacy.tier").alias("tier"), F.array_join("legitimacy.reasons", "; ").alias("reasons"))


_PAGE_BODY = "CASE WHEN page_id % 10 = 3 THEN html || ' <p>No longer accepting applications</p>' WHEN page_id % 10 = 4 THEN html || ' Job Not Found' ELSE html END"
_CLOSED = "(?i)" + "|".join(verification.CLOSED_PHRASES)


def page_fetches(spark, sf):
    """Landed fetches derived from the pages; number 4 of ten is no web page."""
    n = F.col("page_id") % 10
    body = F.when(n == 3, F.concat("html", F.lit(" <p>No longer accepting applications</p>"))).when(n == 4, F.concat("html", F.lit(" Job Not Found")))
    return L.table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.when(n == 0, F.lit(404)).when(n == 1, F.lit(410)).when(n != 2, F.lit(200)).alias("http_status"),
        F.when(n == 4, F.lit("application/pdf")).when(n != 2, F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(n != 2, F.coalesce(body, F.col("html"))).alias("body"),
        F.when(n == 2, F.lit("timed out")).alias("error"),
    )


@query("looks_closed", f"SELECT page_id, regexp_matches({_PAGE_BODY}, {O.q(_CLOSED)}) AS closed FROM pages WHERE page_id % 10 <> 2")
def looks_closed(spark, sf):
    rows = page_fetches(spark, sf).filter(F.col("body").isNotNull())
    return rows.select("page_id", verification.looks_closed(F.col("body")).alias("closed"))


_LIVE = (
    "SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'expired' WHEN 1 THEN 'expired' WHEN 2 THEN 'unknown' "
    f"WHEN 4 THEN 'ok' ELSE CASE WHEN regexp_matches({_PAGE_BODY}, {O.q(_CLOSED)}) THEN 'expired' ELSE 'ok' END END AS tier, "
    "CASE page_id % 10 WHEN 0 THEN 'Listing page returns HTTP 404' WHEN 1 THEN 'Listing page returns HTTP 410' "
    "WHEN 2 THEN 'Could not reach the listing: timed out' WHEN 4 THEN '' "
    f"ELSE CASE WHEN regexp_matches({_PAGE_BODY}, {O.q(_CLOSED)}) THEN {O.q(verification.CLOSED_REASON)} ELSE '' END END AS reasons, "
    "CAST(CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN NULL ELSE 200 END AS INTEGER) AS http_status FROM pages"
)


def _verdict(column: str):
    return [
        F.col(f"{column}.tier").alias("tier"),
        F.array_join(f"{column}.reasons", "; ").alias("reasons"),
        F.col(f"{column}.http_status").alias("http_status"),
    ]


@query("classify_liveness", _LIVE)
def classify_liveness(spark, sf):
    return verification.classify_liveness(page_fetches(spark, sf)).select("page_id", *_verdict("liveness"))


def _numbered_fetches(spark, sf):
    """A fetch per page, keyed by the document it belongs to."""
    return page_fetches(spark, sf).withColumn("doc_id", F.col("page_id"))


@query(
    "combine_verification",
    O.with_(
        f"SELECT id, CASE WHEN {_TIER} = 'scam' THEN 'scam' WHEN v.tier = 'expired' THEN 'expired' WHEN {_TIER} = 'suspicious' THEN 'suspicious' "
        "WHEN v.tier IS NULL OR v.tier = 'unknown' THEN 'unknown' ELSE 'ok' END AS tier, "
        f"CASE WHEN {_TIER} = 'scam' THEN said ELSE concat_ws('; ', nullif(said, ''), nullif(coalesce(v.reasons, 'Could not reach the listing: no fetch landed'), '')) END AS reasons, "
        f"CASE WHEN {_TIER} <> 'scam' THEN v.http_status END AS http_status "
        f"FROM (SELECT *, array_to_string(list_transform(signals, lambda s: s.reason), '; ') AS said FROM ({_LEGIT})) JOIN (SELECT id, doc_id FROM listings) USING (id) "
        f"LEFT JOIN ({_LIVE}) v ON v.page_id = doc_id",
        "listings",
    ),
)
def combine_verification(spark, sf):
    verified = verification.verify(L.listings(spark, sf, keep=("doc_id",)), _numbered_fetches(spark, sf), L.NOW, on="doc_id")
    return verified.select("id", *_verdict("verification"))


def _third_verified(spark, sf):
    """Every third listing is verified already."""
    scored = ranking.prescore(L.curated(spark, sf), L.PROFILE, L.NOW)
    done = F.struct(F.lit("ok").alias("tier"), F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("timestamp").alias("checked_at"), F.lit(200).alias("http_status"))
    return scored.withColumn("verification", F.when(F.col("doc_id") % 3 == 0, done))


@query("verify_pending", O.with_("SELECT id FROM scored WHERE doc_id % 3 <> 0", "scored"))
def verify_pending(spark, sf):
    return verification.verify_pending(_third_verified(spark, sf)).select("id")


@query("verify_pending_budget", O.with_("SELECT id FROM scored WHERE doc_id % 3 <> 0 ORDER BY prescore DESC, id LIMIT 400", "scored"))
def verify_pending_budget(spark, sf):
    """With a fetch budget: the first in listing order."""
    return verification.verify_pending(_third_verified(spark, sf), 400).select("id")


@query("verify_recheck", O.with_("SELECT id FROM scored WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0", "scored"))
def verify_recheck(spark, sf):
    """Of the verified third, those that came out unknown are due again."""
    view = _third_verified(spark, sf)
    doubtful = F.col("verification").isNotNull() & (F.col("doc_id") % 2 == 0)
    tier = F.when(doubtful, F.col("verification").withField("tier", F.lit("unknown"))).otherwise(F.col("verification"))
    return verification.verify_pending(view.withColumn("verification", tier), recheck_unknown=True).select("id")


# --- ranking ---

_PARTS = O.prescore_parts()


def _rank_part(name: str, column) -> None:
    key = {"skills": "skill_overlap", "title": "title_affinity", "recency": "recency", "weight": "eligibility_weight"}[name]

    @query(key, O.with_(f"SELECT id, CAST(round({_PARTS[name]}, 6) AS DOUBLE) AS value FROM curated", "curated"))
    def run(spark, sf):
        return L.curated(spark, sf).select("id", F.round(column(), 6).alias("value"))


_rank_part("skills", lambda: ranking.skill_overlap(searchable_text(), L.PROFILE))
_rank_part("title", lambda: ranking.title_affinity(F.col("title"), L.PROFILE))
_rank_part("recency", lambda: ranking.recency(F.col("posted_at"), L.NOW))
_rank_part("weight", lambda: ranking.eligibility_weight(ranking.effective_eligibility(F.col("eligibility_override"), F.col("eligibility"))))


def scored(spark, sf):
    return ranking.prescore(L.curated(spark, sf), L.PROFILE, L.NOW)


@query("prescore", O.with_("SELECT id, CAST(prescore AS DOUBLE) AS prescore FROM scored", "scored"))
def prescore(spark, sf):
    return scored(spark, sf).select("id", "prescore")


@query("rank", O.with_("SELECT id, CAST(prescore AS DOUBLE) AS prescore, row_number() OVER (ORDER BY prescore DESC, id) AS position FROM scored", "scored"))
def rank(spark, sf):
    return ranking.rank_positions(scored(spark, sf).select("id", "prescore"))


@query("topk_pending", O.with_("SELECT id, CAST(prescore AS DOUBLE) AS prescore FROM scored WHERE doc_id % 5 <> 0 ORDER BY prescore DESC, id LIMIT 200", "scored"))
def topk_pending(spark, sf):
    """Every fifth listing has its match; of the rest the best 200."""
    done = F.struct(F.lit(50).alias("score"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("gaps"), F.lit("p").alias("provider"), F.lit(None).cast("timestamp").alias("scored_at"))
    view = scored(spark, sf).withColumn("match", F.when(F.col("doc_id") % 5 == 0, done))
    return ranking.topk_pending(view, 200).select("id", "prescore")


@query(
    "run_report",
    O.with_(
        f"SELECT 'fetched' AS stage, count(*) AS n FROM raw UNION ALL SELECT 'normalised', count(*) FROM norm "
        "UNION ALL SELECT 'deduplicated', count(*) FROM curated "
        "UNION ALL SELECT e, (SELECT count(*) FROM curated WHERE effective = e) FROM (SELECT unnest(['eligible', 'ineligible', 'unknown']) AS e) "
        f"UNION ALL SELECT 'filtered_out', count(*) FROM curated WHERE ({O.drop_reason()}) IS NOT NULL "
        "UNION ALL SELECT 'verified', count(*) FROM curated WHERE doc_id % 3 = 0 UNION ALL SELECT 'scored', count(*) FROM curated WHERE doc_id % 5 = 0 "
        "UNION ALL SELECT 'errors', 0",
        "curated",
    ),
)
def run_report(spark, sf):
    """A run over all documents: every third listing verified, every fifth scored."""
    from siftline.operators.normalise import drop_unusable

    raw = L.raw_listings(spark, sf)
    filtered = funnel.apply_filters(L.curated(spark, sf), L.CRITERIA, L.NOW)
    judged = filtered.select("doc_id", reports.effective().alias("outcome"), "drop_reason")
    return reports.funnel_report(
        fetched=raw,
        normalised=drop_unusable(raw),
        deduplicated=judged,
        verdicts=judged,
        drops=judged,
        verified=judged.filter("doc_id % 3 = 0"),
        scored=judged.filter("doc_id % 5 = 0"),
    )
