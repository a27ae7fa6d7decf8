"""The explainable three-state verdict of a listing for one profile.

Rules are compiled to Columns: a narrow projection without a shuffle. Rules the
profile is exempt from never reach the plan. A text is cut into words once, and
only phrases all of whose words stand in it are looked for at all. Whether any
phrase of a dimension occurs is then asked with one merged pattern; only rows that
pass are examined phrase by phrase for the first declared match.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.patterns import any_phrase, phrase, pieces, sql_string
from siftline.functions.text import bind, join_fields, literal
from siftline.operators.once import compute_once
from siftline.operators.predicates import PREDICATES
from siftline.operators.rules import Rule, RuleSet
from siftline.schema import DIMENSION_VERDICT, ELIGIBILITY, ELIGIBILITY_VERDICT, SEARCHABLE_FIELDS, Profile

# The summary sentences.
NO_RESTRICTIONS = "No restrictions found"
UNDETERMINED = "Could not determine eligibility from the listing"

# Fields of a rule to the name of the column that holds their joined text; beside
# it, under the same name and this ending, are the phrases that may occur there.
Scopes = Mapping[tuple[str, ...], str]
POSSIBLE = "_possible"
# The other letters that a case-blind pattern takes for i, i, s and k.
LOOKALIKES = ("\u0130\u0131\u017f\u212a", "iisk")


def possible_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Those of the phrases whose words all stand in the text: a necessary
    condition for a phrase to occur, from one cutting of the text into words."""
    table = [{"phrase": p, "pieces": pieces(p)} for p in dict.fromkeys(phrases)]
    wanted = sorted({w for row in table for w in row["pieces"]})
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in LOOKALIKES[0]])
    lowered = F.lower(F.when(odd, F.translate(text, *LOOKALIKES)).otherwise(text))
    words = F.array_intersect(literal(wanted, "array<string>"), F.split(lowered, "[^a-z0-9]+"))
    each = literal(table, "array<struct<phrase:string,pieces:array<string>>>")
    met = bind(words, lambda w: F.filter(each, lambda p: F.forall(p["pieces"], lambda x: F.array_contains(w, x))))
    return F.transform(met, lambda p: p["phrase"])


def _possible(column: str, phrases: Iterable[str]) -> str:
    listed = ", ".join(sql_string(p) for p in phrases)
    return f"arrays_overlap({column}{POSSIBLE}, array({listed}))"


def match_phrases(column: str, any_of: Sequence[str], all_of: Sequence[str], screened: bool = False) -> Column:
    """The matched text in the named column, or null.

    Every ``all_of`` phrase must occur; then the first declared ``any_of`` phrase
    that occurs supplies the text. With ``all_of`` alone, its first phrase does.
    ``screened`` tells that the column of possible phrases stands beside it.
    Written as SQL text because a rule easily holds twenty phrases.
    """
    source = any_of or all_of[:1]
    first = [f"nullif(regexp_extract({column}, {sql_string(phrase(p))}, 0), '')" for p in source]
    needed = [phrase(p) for p in all_of] + ([any_phrase(any_of)] if any_of else [])
    conditions = [f"{column} RLIKE {sql_string(p)}" for p in needed]
    if screened:
        first = [f"CASE WHEN array_contains({column}{POSSIBLE}, {sql_string(p)}) THEN {f} END" for p, f in zip(source, first)]
        conditions.insert(0, _possible(column, source))
    return F.expr(f"CASE WHEN {' AND '.join(conditions)} THEN coalesce({', '.join(first)}) END")


def scope_fields(fields: Sequence[str]) -> Column:
    """The text a rule looks at: its fields, joined by newlines."""
    return join_fields([F.col(name) for name in fields])


def _rule_verdict(rule: Rule, scopes: Scopes, profile: Profile, now: datetime, matched_chars: int | None) -> Column:
    if rule.predicate is not None:
        matched = PREDICATES[rule.predicate](F.col(scopes[SEARCHABLE_FIELDS]), profile, now)
        field = rule.predicate
    else:
        matched = match_phrases(scopes[rule.fields], rule.any_phrase, rule.all_phrases, screened=True)
        field = ",".join(rule.fields)
    evidence = "text" if rule.predicate is not None else sql_string(rule.evidence)
    excerpt = "text" if matched_chars is None else f"substring(text, 1, {matched_chars})"
    verdict = F.expr(
        "text -> CASE WHEN text IS NOT NULL THEN named_struct("
        f"'dimension', {sql_string(rule.dimension)}, 'eligibility', {sql_string(rule.verdict)}, "
        f"'rule_id', {sql_string(rule.id)}, 'evidence', {evidence}, "
        f"'matched_text', {excerpt}, 'source_field', {sql_string(field)}) END"
    )
    return F.get(F.call_function("transform", F.array(matched), verdict), F.lit(0))


def _unknown(dimension: str) -> Column:
    nothing = ", ".join(f"'{n}', CAST(NULL AS STRING)" for n in ("rule_id", "evidence", "matched_text", "source_field"))
    return F.expr(f"named_struct('dimension', {sql_string(dimension)}, 'eligibility', 'unknown', {nothing})")


def _screen(rules: Sequence[Rule], scopes: Scopes) -> Column | None:
    """A cheap necessary condition for any of the rules, where one is known."""
    tests = []
    phrases: dict[tuple[str, ...], list[str]] = {}
    for rule in rules:
        if rule.predicate is None:
            # Every rule needs at least one of these phrases to occur.
            phrases.setdefault(rule.fields, []).extend(rule.any_phrase or rule.all_phrases[:1])
        elif rule.predicate.startswith("timezone."):
            tests.append(F.lower(F.col(scopes[SEARCHABLE_FIELDS])).contains("overlap"))
        else:
            return None
    for fields, texts in phrases.items():
        column = scopes[fields]
        tests.append(F.expr(_possible(column, texts)) & F.col(column).rlike(any_phrase(texts)))
    if not tests:
        return None
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def resolve_dimension(
    dimension: str, scopes: Scopes, profile: Profile, ruleset: RuleSet, now: datetime, matched_chars: int | None = None
) -> Column:
    """The first rule of the dimension that matches, else ``unknown``."""
    rules = ruleset.active(dimension, profile)
    unknown = _unknown(dimension).cast(DIMENSION_VERDICT)
    if not rules:
        return unknown
    decided = F.coalesce(*[_rule_verdict(r, scopes, profile, now, matched_chars) for r in rules], unknown)
    screen = _screen(rules, scopes)
    return decided if screen is None else F.when(screen, decided).otherwise(unknown)


def combine(dimensions: Column) -> Column:
    """Any blocker decides; otherwise any support; otherwise unknown."""

    def has(outcome: str) -> Column:
        return F.exists(dimensions, lambda d: d["eligibility"] == outcome)

    return F.when(has("ineligible"), F.lit("ineligible")).when(has("eligible"), F.lit("eligible")).otherwise(F.lit("unknown"))


def resolve_eligibility(
    listings: DataFrame,
    profile: Profile,
    ruleset: RuleSet,
    now: datetime,
    name: str = "eligibility",
    matched_chars: int | None = None,
) -> DataFrame:
    """Add the verdict struct. It labels every row and drops none.

    The matched text is whole unless ``matched_chars`` limits it.
    """
    if not ruleset.dimensions:
        empty = F.struct(F.lit("unknown").alias("eligibility"), F.array().alias("dimensions"))
        return listings.withColumn(name, empty.cast(ELIGIBILITY_VERDICT))
    rules = [r for d in ruleset.dimensions for r in ruleset.active(d, profile) if r.predicate is None]
    needed = {SEARCHABLE_FIELDS} | {r.fields for r in rules}
    columns = {fields: f"_scope_{i}" for i, fields in enumerate(sorted(needed))}
    scoped = listings.withColumns({column: scope_fields(fields) for fields, column in columns.items()})
    searched = {fields: [p for r in rules if r.fields == fields for p in r.any_phrase or r.all_phrases[:1]] for fields in columns}
    possible = {f"{column}{POSSIBLE}": possible_phrases(F.col(column), searched[fields]) for fields, column in columns.items()}
    scoped = scoped.withColumns(possible)
    dimensions = [resolve_dimension(d, columns, profile, ruleset, now, matched_chars) for d in ruleset.dimensions]
    resolved = compute_once(scoped, {"_dimensions": F.array(*dimensions)}).drop(*columns.values(), *possible)
    verdict = F.struct(combine(F.col("_dimensions")).alias("eligibility"), F.col("_dimensions").alias("dimensions"))
    return resolved.withColumn(name, verdict.cast(ELIGIBILITY_VERDICT)).drop("_dimensions")


def effective_eligibility(override: Column, verdict: Column) -> Column:
    """The user's override wins over the rules; never null."""
    return F.coalesce(override, verdict["eligibility"], F.lit("unknown"))


def blocking(verdict: Column) -> Column:
    return F.filter(verdict["dimensions"], lambda d: d["eligibility"] == "ineligible")


def summary(verdict: Column) -> Column:
    """One line that explains the verdict."""

    def reasons(outcome: str) -> Column:
        hits = F.filter(verdict["dimensions"], lambda d: d["eligibility"] == outcome)
        return F.array_join(F.transform(hits, lambda d: F.coalesce(F.nullif(d["evidence"], F.lit("")), d["dimension"])), "; ")

    return (
        F.when(verdict["eligibility"] == "ineligible", reasons("ineligible"))
        .when(verdict["eligibility"] == "eligible", F.coalesce(F.nullif(reasons("eligible"), F.lit("")), F.lit(NO_RESTRICTIONS)))
        .otherwise(F.lit(UNDETERMINED))
    )


def explain_dimensions(labelled: DataFrame) -> DataFrame:
    """One row per listing and dimension, with the evidence.

    The outer form stops the planner from testing the array for emptiness before
    the scan, which would work out every verdict twice.
    """
    return labelled.select("id", F.inline_outer("eligibility.dimensions")).filter(F.col("dimension").isNotNull())


def eligibility_counts(labelled: DataFrame, outcome: Column | None = None) -> DataFrame:
    """Rows per outcome, with a zero for an outcome that did not occur."""
    value = F.col("eligibility.eligibility") if outcome is None else outcome
    counted = labelled.agg(*[F.count_if(value == e).alias(e) for e in ELIGIBILITY])
    pairs = F.array(*[F.struct(F.lit(e).alias("eligibility"), F.col(e).alias("n")) for e in ELIGIBILITY])
    return counted.select(F.inline(pairs))
