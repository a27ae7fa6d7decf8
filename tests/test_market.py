"""Pay outside its market, returning vacancies, and verdicts for many profiles."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftline.operators import profiles, rates, reposts
from siftline.operators.eligibility import resolve_eligibility
from siftline.operators.rules import RuleSet, load_rules
from siftline.plans import listing_data as L
from siftline.schema import Profile

PAID = "id string, contract_type string, compensation struct<minimum:decimal(14,2),maximum:decimal(14,2),currency:string,period:string>, figure string"
NOW = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Other tests look at plans, where cached tables would show."""
    yield
    spark.catalog.clearCache()


def paid(spark, rows):
    return spark.createDataFrame([(i, kind, None if low is None and cur is None else (low, None, cur, per), "clash") for i, kind, low, cur, per in rows], PAID)


def market_rows():
    from decimal import Decimal

    rng = random.Random(1)
    rows = [(f"u{i}", "full_time", Decimal(80_000 + 400 * rng.randint(0, 100)), "USD", "yearly") for i in range(200)]
    rows += [("low", "full_time", Decimal(80), "usd", "yearly"), ("high", "full_time", Decimal(9_000_000), "USD", "yearly")]
    rows += [("same", "contract", Decimal(50), "EUR", "hourly")] * 30 + [("odd", "contract", Decimal(51), "EUR", "hourly")]
    rows += [("few", None, Decimal(1), "GBP", "daily"), ("few2", None, Decimal(10**9), "GBP", "daily")]
    return rows + [("n1", None, None, None, None), ("n2", "x", None, "USD", "yearly"), ("z", "full_time", Decimal(0), "USD", "yearly"), ("p", "full_time", Decimal(5), "USD", None)]


def test_rates_outside_their_market(spark):
    rows = market_rows()
    listings = paid(spark, rows)
    bounds = rates.rate_bounds(rates.rate_sketches(listings))
    found = {(r["id"], r["problem"]) for r in rates.implausible_rates(listings, bounds).collect()}
    assert found == {("low", "rate_low"), ("high", "rate_high"), ("odd", "rate_high")}
    groups = defaultdict(list)
    for _, kind, low, cur, per in rows:
        if low and cur and per:
            groups[(cur.upper(), per, kind or "unknown")].append(float(low))
    for r in bounds.collect():
        values = sorted(groups.pop((r["currency"], r["period"], r["contract_type"])))
        at = [values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.25, 0.5, 0.75)]
        assert [r["n"], r["q1"], r["median"], r["q3"]] == [len(values), *at]
        assert (r["low"] is None) == (len(values) < rates.LEAST)
    assert not groups


def test_sketches_of_runs_merge(spark):
    listings = paid(spark, market_rows())
    parts = [rates.rate_sketches(listings.filter(F.abs(F.hash("id")) % 3 == i)) for i in range(3)]
    merged = rates.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    both = [sorted(map(tuple, rates.rate_bounds(s).collect())) for s in (merged, rates.rate_sketches(listings))]
    assert both[0] == both[1]


def test_large_sketches_stay_within_their_error(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("contract_type"), F.struct((F.col("id") + 1).cast("decimal(14,2)").alias("minimum"), F.lit("USD").alias("currency"), F.lit("yearly").alias("period")).alias("compensation"))
    r = rates.rate_bounds(rates.rate_sketches(rows.repartition(6))).first()
    assert r["n"] == 200_000
    for name, want in (("q1", 50_000), ("median", 100_000), ("q3", 150_000)):
        assert abs(r[name] - want) < 0.002 * 200_000


def test_no_rates(spark):
    empty = paid(spark, [])
    assert rates.implausible_rates(empty, rates.rate_bounds(rates.rate_sketches(empty))).count() == 0


SIGHTED = "id string, company string, title string, source string, run int, shape string"


def sighted(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SIGHTED).repartition(3)


@pytest.mark.parametrize(
    ("title", "shape"),
    [("Senior Engineer (Remote, US)", "senior engineer"), ("Senior  ENGINEER #4521", "senior engineer"), ("[Urgent] Größte Köchin", "größte köchin"), ("42", None), (None, None), ("C++ / C#", "c c")],
)
def test_title_shape(spark, title, shape):
    frame = spark.createDataFrame([(title,)], "t string")
    assert frame.select(reposts.title_shape(F.col("t")).alias("s")).first()["s"] == shape


def test_vacancies_that_return(spark):
    rows = [("a1", "Acme", "Engineer (1)", "s", r) for r in (1, 2)] + [("a2", " acme", "engineer #2", "s", r) for r in (5, 6)]
    rows += [("b1", "Bolt", "Cook", "s", r) for r in (1, 2, 5, 6)]  # back, but the same id
    rows += [("c1", "Core", "Nurse", "s", 1), ("c1", "Core", "Nurse", "s", 1), ("c2", "Core", "Nurse", "t", 1)]
    rows += [("d1", "Dell", "Clerk", "s", 1), ("d2", "Dell", "Clerk", "s", 2)]  # a new id without a gap
    rows += [("e1", None, "Engineer", "s", 1), ("e2", "", "Engineer", "s", 5), (None, "Acme", "Engineer", "s", 3), ("x", "Acme", "Engineer", "s", None)]
    rows += [("z", "Zoo", "Vet", "s", r) for r in (3, 4)]
    found = {r["company"]: r.asDict() for r in reposts.repost_patterns(sighted(spark, rows)).collect()}
    assert set(found) == {"acme", "core"}
    acme = found["acme"]
    assert (acme["pattern"], acme["n_posts"], acme["longest_gap"], acme["n_returned_ids"], acme["first_run"], acme["last_run"], acme["n_runs"]) == ("reposted", 2, 2, 1, 1, 6, 4)
    assert (found["core"]["pattern"], found["core"]["n_ids"], found["core"]["n_sources"]) == ("spread", 2, 2)
    assert reposts.repost_patterns(sighted(spark, [])).count() == 0


def test_hot_company_is_summed_before_its_window(spark):
    """A row a run reaches the window, however many listings a company has."""
    rows = sighted(spark, [(f"i{n}", "Hot", "Engineer", "s", n % 7) for n in range(5000)])
    assert reposts.islands(rows).count() == 7


def some_profiles():
    base = L.PROFILE
    kinds = [
        base, Profile(country="US", timezone="America/Los_Angeles", work_authorisation=("US",), contract_types=("contract",), currencies=("EUR",)),
        Profile(country="DE", timezone="Europe/Berlin", contract_types=("part_time", "full_time"), currencies=("INR", "usd")), Profile(country="ZZ", timezone="No/Where"), Profile(country="GB", timezone="Europe/London", work_authorisation=("GB", "US")),
    ]
    return {f"p{i}": kinds[i % len(kinds)] for i in range(12)}


def test_many_profiles_equal_single_runs(spark):
    listings = L.listings(spark, "/root/testdata/sf0.001").cache()
    rules, many = load_rules(), some_profiles()
    names = ("id", "dimension", "eligibility", "rule_id", "evidence", "matched_text", "source_field")
    found = defaultdict(set)
    resolved = profiles.resolve_profiles(listings, many, rules, L.NOW)
    for r in resolved.collect():
        found[r["profile"]].add(tuple(r[n] for n in names))
    totals = {(r["profile"], r["id"]): r["eligibility"] for r in profiles.verdicts(resolved).collect()}
    for name in list(many)[:5]:
        single = resolve_eligibility(listings, many[name], rules, L.NOW).select("id", "eligibility").collect()
        want = {(r["id"], d["dimension"], d["eligibility"], d["rule_id"], d["evidence"], d["matched_text"], d["source_field"]) for r in single for d in r["eligibility"]["dimensions"] if d["eligibility"] != "unknown"}
        assert found[name] == want and want
        assert all(totals.get((name, r["id"]), "unknown") == r["eligibility"]["eligibility"] for r in single)
    assert found["p0"] == found["p5"] == found["p10"]


def test_a_thousand_profiles_read_the_texts_once(spark):
    listings = L.listings(spark, "/root/testdata/sf0.001")
    many = {f"p{i}": p for i in range(84) for p in some_profiles().values()} | {f"q{i}-{k}": p for i in range(84) for k, p in some_profiles().items()}
    assert len(many) > 1000
    kinds, members = profiles.classes(many, load_rules())
    assert len(kinds) == 5 and len(members) == len(many)
    scans = [f._jdf.queryExecution().executedPlan().toString().count("FileScan") for f in (listings, profiles.hit_table(listings, load_rules()))]
    assert scans[0] == scans[1]
    hits = profiles.hit_table(listings, load_rules()).cache()
    assert profiles.resolve_profiles(listings, many, load_rules(), L.NOW, hits).select("profile").distinct().count() > 900


def test_no_profiles_and_no_rules(spark):
    listings = L.listings(spark, "/root/testdata/sf0.001")
    assert profiles.resolve_profiles(listings, {}, load_rules(), L.NOW).count() == 0
    assert profiles.resolve_profiles(listings, some_profiles(), RuleSet(()), L.NOW).count() == 0
