from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siftline.operators import funnel, ranking, verification
from siftline.plans.listing_data import NOW, PROFILE
from siftline.schema import Criteria, FilterSettings, criteria_from_profile

SCHEMA = (
    "id string, title string, company string, description string, location_text string, contract_type string, "
    "compensation struct<minimum:decimal(20,4),maximum:decimal(20,4),currency:string,period:string>, posted_at timestamp, "
    "status string, eligibility_override string, eligibility struct<eligibility:string,dimensions:array<struct<eligibility:string>>>, "
    "verification struct<tier:string>"
)
DEFAULTS = {
    "id": "a", "title": "Senior Backend Engineer", "company": "Acme", "description": "Python and Docker on AWS", "location_text": None,
    "contract_type": "full_time", "compensation": (None, None, None, None), "posted_at": NOW.replace(tzinfo=None),
    "status": "new", "eligibility_override": None, "eligibility": ("unknown", []), "verification": None,
}
CRITERIA = criteria_from_profile(PROFILE)


@pytest.fixture(scope="module")
def jobs(spark):
    def build(*edits):
        return spark.createDataFrame([tuple({**DEFAULTS, "id": str(i), **e}.values()) for i, e in enumerate(edits)], SCHEMA)

    return build


def reasons(frame, criteria):
    rows = funnel.apply_filters(frame, criteria, NOW).select("id", "drop_reason").collect()
    return [r["drop_reason"] for r in sorted(rows, key=lambda r: int(r["id"]))]


DAYS = timedelta(days=1)
STAMP = NOW.replace(tzinfo=None)


@pytest.mark.parametrize(
    "edit, criteria, expected",
    [
        ({}, CRITERIA, None),
        ({"status": "dismissed"}, CRITERIA, "status_dismissed"),
        ({"status": "dismissed"}, replace(CRITERIA, include_dismissed=True), None),
        ({"eligibility": ("ineligible", [])}, CRITERIA, "ineligible"),
        ({"eligibility": ("ineligible", []), "eligibility_override": "eligible"}, CRITERIA, None),
        ({"eligibility": None}, CRITERIA, None),
        ({}, replace(CRITERIA, exclude_unknown_eligibility=True), "unknown_eligibility"),
        ({"verification": ("scam",)}, CRITERIA, "verification"),
        ({"verification": ("suspicious",)}, CRITERIA, None),
        ({"title": "Internal Tools Engineer"}, CRITERIA, "title_excluded"),
        ({"title": "VP Engineering"}, CRITERIA, "title_excluded"),
        ({}, replace(CRITERIA, required_title_phrases=("frontend",)), "title_not_matched"),
        ({"posted_at": STAMP - 31 * DAYS}, replace(CRITERIA, max_age_days=30), "too_old"),
        ({"posted_at": STAMP - 30 * DAYS}, replace(CRITERIA, max_age_days=30), None),
        ({"posted_at": None}, replace(CRITERIA, max_age_days=30), None),
        ({"contract_type": "internship"}, CRITERIA, "contract_type"),
        ({"contract_type": "unknown"}, CRITERIA, None),
        ({"compensation": (Decimal(20), None, "USD", "hourly")}, replace(CRITERIA, min_hourly_rate_usd=Decimal(30)), "below_min_rate"),
        ({"compensation": (Decimal(20), None, None, "hourly")}, replace(CRITERIA, min_hourly_rate_usd=Decimal(30)), None),
        ({"compensation": (Decimal(20), None, "XYZ", "hourly")}, replace(CRITERIA, min_hourly_rate_usd=Decimal(30)), None),
        ({"description": "We bake bread"}, CRITERIA, "no_signal"),
        ({"description": "We bake bread"}, replace(CRITERIA, tech_keywords=()), None),
        ({"description": "pythonic bread"}, CRITERIA, "no_signal"),
        ({"status": "dismissed", "title": "Recruiter", "description": ""}, CRITERIA, "status_dismissed"),
    ],
)
def test_reason(jobs, edit, criteria, expected):
    assert reasons(jobs(edit), criteria) == [expected]


def test_kept_and_dropped_add_up(jobs):
    frame = jobs({}, {"status": "dismissed"}, {"title": "Recruiter"}, {"title": "Sales"})
    dropped = {r["drop_reason"]: r["n"] for r in funnel.drop_counts(funnel.apply_filters(frame, CRITERIA, NOW)).collect()}
    assert dropped == {"status_dismissed": 1, "title_excluded": 2}
    assert funnel.kept(frame, CRITERIA, NOW).count() + sum(dropped.values()) == 4


def test_criteria_from_profile():
    made = criteria_from_profile(replace(PROFILE, min_hourly_rate_usd=Decimal(40)), FilterSettings(excluded_title_phrases=("x",)))
    assert made.excluded_title_phrases == ("x",) and made.min_hourly_rate_usd == Decimal(40)
    assert made.tech_keywords == PROFILE.skills and made.contract_types == PROFILE.contract_types
    assert criteria_from_profile(PROFILE).excluded_title_phrases == Criteria.DEFAULT_EXCLUDED_TITLES
    assert criteria_from_profile(PROFILE, FilterSettings(min_hourly_rate_usd=Decimal(0))).min_hourly_rate_usd == 0


# --- ranking ---


def test_skill_boundaries(jobs):
    profile = replace(PROFILE, skills=("C++", "C#", "Go", "R"))
    frame = jobs({"description": "C++ and C#, going for gold"}, {"description": "go"}, {"description": "c++11"}, {"description": "we use R."})
    from siftline.functions.text import searchable_text

    got = [r["s"] for r in frame.select("id", ranking.skill_overlap(searchable_text(), profile).alias("s")).orderBy("id").collect()]
    assert got == [0.5, 0.25, 0.0, 0.25]


def test_title_recency_and_total(jobs):
    frame = jobs(
        {}, {"title": "Platform Wizard"}, {"title": "Cook"}, {"posted_at": None}, {"posted_at": STAMP - 60 * DAYS},
        {"posted_at": STAMP + DAYS}, {"posted_at": STAMP - timedelta(days=33, hours=12)}, {"eligibility": ("eligible", [])},
    )
    got = [r["prescore"] for r in ranking.prescore(frame, PROFILE, NOW).orderBy(F.col("id").cast("int")).collect()]
    base = 0.55 * 0.6 + 0.06
    expected = [base + 0.35, base + 0.225, base + 0.1, base + 0.30, base + 0.25, base + 0.35, base + 0.30, base + 0.39]
    assert got == pytest.approx(expected, abs=1e-6)
    assert all(0 <= g <= 1 for g in got)


def test_positions_match_the_global_order(spark):
    from siftline.functions.text import short_sha256

    rows = spark.range(3000).select(
        short_sha256(F.col("id").cast("string")).alias("id"),
        # A third of all rows share one score.
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") % 97) / 97).alias("prescore"),
    )
    got = [(r["position"], r["id"]) for r in ranking.rank_positions(rows).collect()]
    want = [r["id"] for r in ranking.rank(rows).collect()]
    assert [i for _, i in sorted(got)] == want and sorted(p for p, _ in got) == list(range(1, 3001))


# --- verification ---


@pytest.mark.parametrize(
    "text, tier",
    [
        ("Pay the registration fee first", "scam"),
        ("a refundable  deposit", "scam"),
        ("Contact us on Telegram", "scam"),
        ("bank account required", "scam"),
        ("no experience required", "suspicious"),
        ("No experience needed, guaranteed income", "scam"),
        ("earn up to $5,000 per week", "suspicious"),
        ("send your CV to a.b@gmail.com", "suspicious"),
        ("coffee is free; card games", "ok"),
        ("paid in crypto", "suspicious"),
    ],
)
def test_legitimacy(jobs, text, tier):
    row = verification.assess_legitimacy(jobs({"description": text})).first()["legitimacy"]
    assert row["tier"] == tier and (tier == "ok") == (row["reasons"] == [])


def test_required_words_are_necessary():
    assert set(verification.REQUIRED_WORDS) == {s[0] for s in verification.SIGNALS}


def test_liveness_and_combination(spark, jobs):
    fetch = "id string, http_status int, content_type string, body string, error string"
    pages = spark.createDataFrame(
        [
            ("0", 404, "text/html", "", None),
            ("1", 200, "text/html", "x" * 70_000 + " Position closed", None),
            ("2", 200, "application/pdf", "position closed", None),
            ("3", None, None, None, "timeout"),
            ("4", 200, "text/html", "open", None),
            ("5", 410, "text/html", "", None),
        ],
        fetch,
    )
    frame = jobs({}, {}, {}, {}, {"description": "no experience required"}, {"description": "registration fee"}, {})
    out = {r["id"]: r["verification"] for r in verification.verify(frame, pages, NOW).collect()}
    assert [out[str(i)]["tier"] for i in range(7)] == ["expired", "expired", "ok", "unknown", "suspicious", "scam", "unknown"]
    assert out["5"]["http_status"] is None and out["0"]["http_status"] == 404
    assert out["3"]["reasons"] == ["Could not reach the listing: timeout"]
