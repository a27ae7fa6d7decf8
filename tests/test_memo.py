"""Verdicts that are remembered equal those that are worked out."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import functions as F

from siftline.operators import memo
from siftline.operators.eligibility import resolve_eligibility
from siftline.operators.rules import RuleSet, load_rules
from siftline.plans import curation
from siftline.plans import listing_data as L

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(str, rows.select("id", "eligibility").collect()))


def test_second_run_labels_what_changed(spark, tmp_path):
    store, rules = curation.Store(spark, str(tmp_path)), load_rules()
    settings = curation.Settings(L.PROFILE, rules, L.CRITERIA)
    first = store.write("listings", 1, L.listings(spark, SF))
    assert plain(curation.label(store, 1, settings, L.NOW)) == plain(resolve_eligibility(first, L.PROFILE, rules, L.NOW))
    changed = F.abs(F.hash("id")) % 50 == 0
    odd = first.limit(1).withColumns({"id": F.lit("null-fields"), **{c: F.lit(None).cast(first.schema[c].dataType) for c in ("company", "location_text", "description", "compensation")}})
    second = store.write("listings", 2, first.withColumn("description", F.when(changed, F.lit("Work from anywhere")).otherwise(F.col("description"))).unionByName(odd))
    assert plain(curation.label(store, 2, settings, L.NOW)) == plain(resolve_eligibility(second, L.PROFILE, rules, L.NOW))
    counted = {r["name"]: r["n"] for r in store.counters(2).collect()}
    assert 0 < counted["labelled"] <= first.filter(changed).count() + 1
    # The run done again labels the same and no more.
    assert plain(curation.label(store, 2, settings, L.NOW)) == plain(resolve_eligibility(second, L.PROFILE, rules, L.NOW))
    # Other rules remember nothing of it.
    other = replace(settings, ruleset=RuleSet(rules.rules[:5]))
    assert plain(curation.label(store, 2, other, L.NOW)) == plain(resolve_eligibility(second, L.PROFILE, other.ruleset, L.NOW))


def test_settings_tell_profiles_rules_and_summer_apart():
    rules = load_rules()
    summer = datetime(2026, 7, 1, tzinfo=timezone.utc)
    keys = {memo.settings_key(p, r, now) for p in (L.PROFILE, replace(L.PROFILE, country="US")) for r in (rules, RuleSet(rules.rules[1:])) for now in (L.NOW, summer)}
    assert len(keys) == 8
    assert memo.settings_key(L.PROFILE, rules, L.NOW) == memo.settings_key(replace(L.PROFILE, resume_text="other"), load_rules(), L.NOW)


def test_no_listings(spark):
    none = L.listings(spark, SF).limit(0)
    assert memo.label_new(none, None, L.PROFILE, load_rules(), L.NOW).count() == 0
