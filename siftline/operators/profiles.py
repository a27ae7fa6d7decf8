"""Verdicts for many profiles from one scan of the texts.

What a listing says does not depend on who reads it. The scan writes down, once
per listing, which rules' phrases occur and which facts the computed rules go by
(contract type, currency, stated overlap). Profiles differ only in which rules
they are exempt from and in the few facets those facts are held against, so equal
ones form a class. Rules and facts are then answered per class on small tables,
hits are joined to them, and the first rule of a dimension that applies decides.

Only determined verdicts are returned: a dimension without a row is unknown, and
so is a listing without any. Verdicts equal those of a run for one profile alone.
Profiles are the driver's: thousands of them, in as many rows. Profiles of one
name count once, the last; listings are as in ``resolve_eligibility``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.patterns import any_phrase
from siftline.operators import predicates
from siftline.operators.eligibility import combine, match_phrases, scope_fields
from siftline.operators.once import compute_once
from siftline.operators.rules import Rule, RuleSet
from siftline.schema import SEARCHABLE_FIELDS, Profile

HIT = "array<struct<position:int,matched:string,fact:struct<contract_type:string,currency:string,hours:string,zone:string>>>"
#: Fields of a fact that each computed rule goes by, and what evaluates it.
_FACTS = {
    "timezone.insufficient_overlap": (("hours", "zone"), lambda f, p, now: predicates.insufficient(f, p, now)),
    "timezone.sufficient_overlap": (("hours", "zone"), lambda f, p, now: predicates.sufficient(f, p, now)),
    "contract.type_mismatch": (("contract_type",), lambda f, p, now: predicates.contract_mismatch(p, f["contract_type"])),
    "currency.unsupported": (("currency",), lambda f, p, now: predicates.unsupported_currency(p, f["currency"])),
}
_FIELDS = ("contract_type", "currency", "hours", "zone")


def hit_table(listings: DataFrame, ruleset: RuleSet) -> DataFrame:
    """``id, position, matched, fact``: a row for each rule that a listing touches.

    One narrow scan, whoever the profiles are. ``position`` is the rule's place
    among the enabled ones; computed rules leave the fact they go by.
    """
    rules = ruleset.enabled
    scopes = {fields: f"_scope_{i}" for i, fields in enumerate(sorted({SEARCHABLE_FIELDS} | {r.fields for r in rules if r.predicate is None}))}
    scoped = listings.withColumns({column: scope_fields(fields) for fields, column in scopes.items()})
    text = scopes[SEARCHABLE_FIELDS]
    # The scan's patterns run only where one merged pattern finds anything.
    for fields, column in scopes.items():
        phrases = [p for r in rules if r.predicate is None and r.fields == fields for p in (r.any_phrase or r.all_phrases[:1])]
        test = F.col(column).rlike(any_phrase(phrases)) if phrases else F.lit(False)
        scoped = compute_once(scoped, {f"{column}_met": test})
    overlap = F.when(F.lower(F.col(text)).contains("overlap"), predicates.stated_overlap(F.col(text)))
    known = compute_once(scoped, {"_stated": overlap})
    facts = {"contract_type": F.col("contract_type"), "currency": F.col("compensation.currency"), "hours": F.col("_stated.hours"), "zone": F.col("_stated.zone")}

    def hit(position: int, rule: Rule):
        if rule.predicate is None:
            column = scopes[rule.fields]
            matched, fact = F.when(F.col(f"{column}_met"), match_phrases(column, rule.any_phrase, rule.all_phrases)), F.lit(None)
            there = matched.isNotNull()
        else:
            used = _FACTS[rule.predicate][0]
            matched = F.lit(None).cast("string")
            fact = F.struct(*[(facts[f] if f in used else F.lit(None).cast("string")).alias(f) for f in _FIELDS])
            there = facts[used[0]].isNotNull()
        return F.when(there, F.struct(F.lit(position).alias("position"), matched.alias("matched"), fact.alias("fact")))

    hits = F.array(*[hit(i, r) for i, r in enumerate(rules)]).cast(HIT) if rules else F.array().cast(HIT)
    found = compute_once(known, {"_hits": F.array_compact(hits)})
    return found.select("id", F.inline("_hits"))


def classes(profiles: Mapping[str, Profile], ruleset: RuleSet) -> tuple[list[Profile], list[tuple[str, int]]]:
    """One profile of each class, and every profile's class."""
    numbers: dict[tuple, int] = {}
    kinds: list[Profile] = []
    members = []
    for name, profile in profiles.items():
        active = tuple(i for i, r in enumerate(ruleset.enabled) if not r.exempts(profile))
        key = (active, profile.contract_types, tuple(sorted({c.upper() for c in profile.currencies})), profile.timezone)
        if key not in numbers:
            numbers[key] = len(kinds)
            kinds.append(replace(profile, resume_text="", skills=(), titles=()))
        members.append((name, numbers[key]))
    return kinds, members


def _answers(spark: SparkSession, facts: DataFrame, kinds: list[Profile], ruleset: RuleSet, now: datetime) -> DataFrame:
    """``kind, position, fact, message``: computed rules that apply, class by class.

    ``facts`` are the distinct ones that occur, as many as contract types,
    currencies and stated overlaps combine to. Classes that share the facets a
    rule reads share its answer.
    """
    result = spark.createDataFrame([], "position int, fact string, facet int, message string, kind int")
    for position, rule in enumerate(ruleset.enabled):
        if rule.predicate is None:
            continue
        evaluate = _FACTS[rule.predicate][1]
        facets: dict[tuple, list[int]] = {}
        for kind, profile in enumerate(kinds):
            if not rule.exempts(profile):
                facet = {"t": (profile.timezone,), "c": profile.contract_types, "u": profile.currencies}["u" if rule.predicate.startswith("currency") else rule.predicate[0]]
                facets.setdefault(facet, []).append(kind)
        if not facets:
            continue
        own = facts.filter(F.col("position") == position)
        said = [F.struct(F.lit(i).alias("facet"), evaluate(F.col("fact"), kinds[members[0]], now).alias("message")) for i, members in enumerate(facets.values())]
        told = own.select("position", F.to_json("fact").alias("fact"), F.inline(F.array(*said))).filter("message IS NOT NULL")
        whose = spark.createDataFrame([(i, k) for i, members in enumerate(facets.values()) for k in members], "facet int, kind int")
        result = result.unionByName(told.join(F.broadcast(whose), "facet"))
    return result.select("kind", "position", "fact", "message")


def resolve_profiles(listings: DataFrame, profiles: Mapping[str, Profile], ruleset: RuleSet, now: datetime, hits: DataFrame | None = None) -> DataFrame:
    """``profile, id, dimension, eligibility, rule_id, evidence, matched_text,
    source_field`` of every determined dimension.

    ``hits`` may be a stored :func:`hit_table`; then texts are not read again.
    """
    spark, rules = listings.sparkSession, ruleset.enabled
    kinds, members = classes(profiles, ruleset)
    found = hit_table(listings, ruleset) if hits is None else hits
    # Rules times classes, and facts times classes: tables of the rule book's size.
    applies = spark.createDataFrame([(k, i) for k, p in enumerate(kinds) for i, r in enumerate(rules) if r.predicate is None and not r.exempts(p)], "kind int, position int")
    phrased = found.filter("fact IS NULL").join(F.broadcast(applies), "position").select("id", "kind", "position", "matched")
    facts = found.filter("fact IS NOT NULL").groupBy("position", "fact").agg(F.lit(1).alias("one")).drop("one")
    answers = _answers(spark, facts, kinds, ruleset, now)
    computed = found.filter("fact IS NOT NULL").select("id", "position", F.to_json("fact").alias("fact")).join(F.broadcast(answers), ["position", "fact"])
    matched = phrased.unionByName(computed.select("id", "kind", "position", F.col("message").alias("matched")))
    told = spark.createDataFrame(
        [(i, r.dimension, r.verdict, r.id, r.evidence, r.predicate or ",".join(r.fields), r.predicate is not None) for i, r in enumerate(rules)],
        "position int, dimension string, eligibility string, rule_id string, evidence string, source_field string, computed boolean",
    )
    first = matched.join(F.broadcast(told.select("position", "dimension")), "position").groupBy("kind", "id", "dimension").agg(F.min(F.struct("position", "matched")).alias("first"))
    decided = first.select("kind", "id", "first.position", "first.matched").join(F.broadcast(told), "position")
    named = decided.join(F.broadcast(spark.createDataFrame(members, "profile string, kind int")), "kind")
    evidence = F.when(F.col("computed"), F.col("matched")).otherwise(F.col("evidence"))
    return named.select("profile", "id", "dimension", "eligibility", "rule_id", evidence.alias("evidence"), F.col("matched").alias("matched_text"), "source_field")


def verdicts(determined: DataFrame) -> DataFrame:
    """``profile, id, eligibility`` of listings with any determined dimension."""
    grouped = determined.groupBy("profile", "id").agg(F.collect_set(F.struct("eligibility")).alias("found"))
    return grouped.select("profile", "id", combine(F.col("found")).alias("eligibility"))
