from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal as D

from siftline.functions import contract, dates, pay
from siftline.plans.listing_data import NOW

PAY = {
    "$120,000 - $150,000 per year": (D(120000), D(150000), "USD", "yearly"),
    "$85 per hour": (D(85), None, "USD", "hourly"),
    "120k-150k USD": (D(120000), D(150000), "USD", "yearly"),
    "£60k": (D(60000), None, "GBP", "yearly"),
    "1.2m INR annually": (D(1200000), None, "INR", "yearly"),
    "₹25,00,000 per annum": (D(2500000), None, "INR", "yearly"),
    "$170K – $200K • 0.1% – 0.3%": (D(170000), D(200000), "USD", "yearly"),
    "90 000 EUR": (D(90000), None, "EUR", "yearly"),
    "US$ 100k": (D(100000), None, "USD", "yearly"),
    "C$90k": (D(90000), None, "CAD", "yearly"),
    "$9,000 monthly": (D(9000), None, "USD", "monthly"),
    "€400 /day": (D(400), None, "EUR", "hourly"),
    "80-110k EUR": (D(110000), None, "EUR", "yearly"),
    "3 months": (None, None, None, None),
    "3+ years experience": (None, None, None, None),
    "Competitive salary": (None, None, None, None),
    "Posted 2024": (None, None, None, None),
    "": (None, None, None, None),
    None: (None, None, None, None),
}


def test_compensation(apply):
    got = apply(list(PAY), pay.parse_compensation)
    assert [tuple(r) for r in got] == list(PAY.values())


def test_amounts_beyond_the_type_are_left_out_not_fatal(apply):
    assert [r["minimum"] for r in apply(["$" + "9" * 40 + "k"], pay.parse_compensation)] == [None]


def test_format_and_hourly(apply):
    shown = apply(["$120k - $150k per year", "$85.50 per hour", "none"], lambda c: pay.format_compensation(pay.parse_compensation(c)))
    assert shown == ["USD 120k–150k/year", "USD 85.5/hour", None]
    hourly = apply(["$192,000 per year", "$85 per hour", "85k"], lambda c: pay.approx_hourly_usd(pay.parse_compensation(c)))
    assert hourly == [100.0, 85.0, None]


def test_posted_at(apply):
    cases = {
        "1740830400": datetime(2025, 3, 1, 12),
        "1740830400000": datetime(2025, 3, 1, 12),
        "3 days ago": datetime(2026, 2, 26, 12),
        "Posted 2 Weeks ago": datetime(2026, 2, 15, 12),
        "2 months ago": datetime(2026, 3, 1, 12) - timedelta(days=60),
        "2026-02-01T10:00:00Z": datetime(2026, 2, 1, 10),
        "2026-02-01T10:00:00": datetime(2026, 2, 1, 10),
        "2026-02-01": datetime(2026, 2, 1),
        "20260201": datetime(2026, 2, 1),
        "2025-09-17T12:31:04-04:00": datetime(2025, 9, 17, 16, 31, 4),
        "2026-02-01T10:00:00.123456789+05:30": datetime(2026, 2, 1, 4, 30, 0, 123456),
        "Fri, 20 Feb 2026 07:30:48 +0000": datetime(2026, 2, 20, 7, 30, 48),
        "20 Feb 2026 07:30 EST": datetime(2026, 2, 20, 12, 30),
        "Fri, 20 Feb 26 07:30:48 GMT": datetime(2026, 2, 20, 7, 30, 48),
    }
    for bad in ("yesterday", "Q3", "12345678", "not a date", "2026", "2026-02", "2026-13-01", "99999999999999999999", "9999999999 years ago", "", None):
        cases[bad] = None
    assert dict(zip(cases, apply(list(cases), lambda c: dates.parse_posted_at(c, NOW)))) == cases


def test_relative_days(apply):
    ages = apply(["2026-03-01", "2026-02-27T12:00:00", "2026-02-20", "2025-12-20", "2026-04-01", "x"], lambda c: dates.relative_days(dates.parse_posted_at(c, NOW), NOW))
    assert ages == ["today", "2d ago", "9d ago", "2mo ago", "today", None]


def test_contract_type(apply):
    cases = {
        "Internship": "internship", "Contract": "contract", "part time": "part_time", "FullTime": "full_time",
        "full_time": "unknown", "intern, full-time": "internship", "internal": "unknown", "": "unknown",
    }
    assert apply(list(cases), contract.parse_contract_type) == list(cases.values())
