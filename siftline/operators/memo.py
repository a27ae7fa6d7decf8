"""Verdicts remembered by what they depend on.

A verdict follows from the fields that rules read, the rules, and the profile. The
fields make a key per listing, rules and profile one for the whole memo; a later
run labels only keys that are new. Listings of equal fields share a verdict, and
are labelled once. Keys of working hours change with summer time, so a profile's
shared hours belong to its key. Null fields are fields like others.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.eligibility import resolve_eligibility
from siftline.operators.predicates import available_hours
from siftline.operators.rules import RuleSet
from siftline.schema import Profile

#: Fields that any rule or computed rule reads.
READ = ("title", "company", "location_text", "description", "contract_type", "compensation")


def settings_key(profile: Profile, ruleset: RuleSet, now: datetime) -> str:
    """One key for rules, the profile's facets and its hours at ``now``."""
    facets = (profile.country, profile.timezone, profile.work_authorisation, profile.contract_types, profile.currencies)
    return hashlib.sha256(repr((ruleset, facets, sorted(available_hours(profile, now).items()))).encode()).hexdigest()[:16]


def verdict_key() -> Column:
    return F.sha2(F.to_json(F.struct(*READ)), 256)


def label_new(listings: DataFrame, memo: DataFrame | None, profile: Profile, ruleset: RuleSet, now: datetime) -> DataFrame:
    """``verdict_key, eligibility`` of the keys that the memo lacks, each once.

    Only keys and ids are compared; the texts of new keys follow by id.
    """
    keyed = listings.withColumn("verdict_key", verdict_key())
    first = keyed.groupBy("verdict_key").agg(F.min("id").alias("id"))
    if memo is not None:
        first = first.join(memo.select("verdict_key"), "verdict_key", "left_anti")
    fresh = listings.join(first, "id")
    return resolve_eligibility(fresh, profile, ruleset, now).select("verdict_key", "eligibility")


def recall(listings: DataFrame, memo: DataFrame) -> DataFrame:
    """``id, eligibility`` of every listing from a complete memo."""
    return listings.select("id", verdict_key().alias("verdict_key")).join(memo.select("verdict_key", "eligibility"), "verdict_key").select("id", "eligibility")
