"""The rule engine and its predicates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftline.functions import clocks
from siftline.functions.patterns import phrase as phrase_pattern
from siftline.operators import eligibility as E
from siftline.operators import memo as ME
from siftline.operators import predicates as P
from siftline.operators import profiles as PR
from siftline.operators.normalise import unique_listings
from siftline.operators.rules import RuleSet, load_rules, parse_rules
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.plans.scratch import scratch_dir

DIMS = "id, dimension, eligibility, rule_id, evidence, matched_text, source_field"
US_PROFILE = replace(L.PROFILE, country="US", timezone="America/Los_Angeles", work_authorisation=("US",))


@query(
    "compile_phrase",
    O.with_(
        " UNION ALL ".join(
            f"SELECT {O.q(p)} AS phrase, count(*) AS n FROM raw WHERE regexp_matches(concat_ws(chr(10), location_text, description), {O.q(O.phrase(p))})"
            for p in ("us only", "remote (us)", "remote - europe", "employer of record", "us")
        ),
        "raw",
    ),
)
def compile_phrase(spark, sf):
    """Rows each phrase occurs in, one scan for all of them."""
    phrases = ("us only", "remote (us)", "remote - europe", "employer of record", "us")
    texts = L.raw_listings(spark, sf).select(E.scope_fields(["location_text", "description"]).alias("t"))
    counted = texts.agg(*[F.count_if(F.col("t").rlike(phrase_pattern(p))).alias(f"p{i}") for i, p in enumerate(phrases)])
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n")) for i, p in enumerate(phrases)])
    return counted.select(F.inline(rows))


_ANY = ("python", "work from anywhere", "us only")
_ALL = ("no experience", "guaranteed income")


@query(
    "match_phrases",
    O.with_(
        f"SELECT id, {O.first_phrase('stext', _ANY)} AS any_text, "
        f"CASE WHEN {' AND '.join(f'regexp_matches(stext, {O.q(O.phrase(p))})' for p in _ALL)} "
        f"THEN {O.first_phrase('stext', _ALL[:1])} END AS all_text FROM listings",
        "listings",
    ),
)
def match_phrases(spark, sf):
    rows = L.listings(spark, sf).withColumn("stext", E.scope_fields(["title", "company", "location_text", "description"]))
    return rows.select(
        "id", E.match_phrases("stext", _ANY, ()).alias("any_text"), E.match_phrases("stext", (), _ALL).alias("all_text")
    )


@query("scope_fields", O.with_("SELECT id, concat_ws(chr(10), company, location_text) AS scope FROM listings", "listings"))
def scope_fields(spark, sf):
    return L.listings(spark, sf).select("id", E.scope_fields(["company", "location_text"]).alias("scope"))


def _dims(spark, sf, dimension=None):
    rows = E.explain_dimensions(L.labelled(spark, sf))
    return rows if dimension is None else rows.filter(F.col("dimension") == dimension)


@query("resolve_dimension", O.with_(f"SELECT {DIMS} FROM dims WHERE dimension = 'location'", "dims"))
def resolve_dimension(spark, sf):
    """One dimension on its own: the plan holds no other dimension's patterns."""
    location = RuleSet(tuple(r for r in load_rules().rules if r.dimension == "location"))
    return E.explain_dimensions(E.resolve_eligibility(L.listings(spark, sf), L.PROFILE, location, L.NOW))


@query("explain_dimensions", O.with_(f"SELECT {DIMS} FROM dims", "dims"))
def explain_dimensions(spark, sf):
    return _dims(spark, sf)


@query("resolve_eligibility", O.with_("SELECT id, verdict AS eligibility, 4 AS n_dimensions FROM verdicts", "verdicts"))
def resolve_eligibility(spark, sf):
    return L.labelled(spark, sf).select(
        "id", F.col("eligibility.eligibility").alias("eligibility"), F.size("eligibility.dimensions").alias("n_dimensions")
    )


@query(
    "combine",
    "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'ineligible' WHEN doc_id % 3 = 0 THEN 'eligible' ELSE 'unknown' END AS outcome FROM labels",
)
def combine(spark, sf):
    def verdict(condition, outcome):
        return F.struct(F.when(condition, F.lit(outcome)).otherwise(F.lit("unknown")).alias("eligibility"))

    dims = F.array(
        verdict(F.col("quality") == 0, "ineligible"),
        verdict(F.col("doc_id") % 3 == 0, "eligible"),
        verdict(F.col("toxic") == 1, "ineligible"),
    )
    return L.table(spark, sf, "labels").select("doc_id", E.combine(dims).alias("outcome"))


@query(
    "blocking",
    O.with_("SELECT id, string_agg(rule_id, ',' ORDER BY ord) AS blockers FROM dims WHERE eligibility = 'ineligible' GROUP BY id", "dims"),
)
def blocking(spark, sf):
    blockers = E.blocking(F.col("eligibility"))
    rows = L.labelled(spark, sf).select("id", F.array_join(F.transform(blockers, lambda d: d["rule_id"]), ",").alias("blockers"))
    return rows.filter(F.col("blockers") != "")


@query("summary", O.with_("SELECT id, summary FROM verdicts", "verdicts"))
def summary(spark, sf):
    return L.labelled(spark, sf).select("id", E.summary(F.col("eligibility")).alias("summary"))


@query(
    "eligibility_counts",
    O.with_(
        "SELECT e AS eligibility, (SELECT count(*) FROM verdicts WHERE verdict = e) AS n "
        "FROM (SELECT unnest(['eligible', 'ineligible', 'unknown']) AS e)",
        "verdicts",
    ),
)
def eligibility_counts(spark, sf):
    return E.eligibility_counts(L.labelled(spark, sf))


@query("rule_hits", O.with_("SELECT rule_id, count(*) AS n FROM dims WHERE rule_id IS NOT NULL GROUP BY rule_id", "dims"))
def rule_hits(spark, sf):
    """How often each shipped rule decides."""
    return _dims(spark, sf).filter(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "profile_exempts",
    O.with_(
        "SELECT id, CASE WHEN "
        + O.first_phrase("stext", [p for r in load_rules().rules if r.id == "loc.us_only" for p in r.any_phrase])
        + " IS NULL THEN false ELSE true END AS restricted, false AS blocked FROM listings",
        "listings",
    ),
)
def profile_exempts(spark, sf):
    """The US rule against a profile in India and against an exempt one."""
    only = RuleSet(tuple(r for r in load_rules().rules if r.id == "loc.us_only"))
    rows = E.resolve_eligibility(L.listings(spark, sf), L.PROFILE, only, L.NOW, name="here")
    both = E.resolve_eligibility(rows, US_PROFILE, only, L.NOW, name="there")
    return both.select(
        "id",
        (F.col("here.eligibility") == "ineligible").alias("restricted"),
        (F.col("there.eligibility") == "ineligible").alias("blocked"),
    )


USER_RULES = {
    "version": 1,
    "rules": [
        {
            "id": "loc.us_only",
            "dimension": "location",
            "when": {"all_phrases": ["remote (us)"], "fields": ["location_text"]},
            "verdict": "eligible",
            "evidence": "I can work from the US",
        },
        {
            "id": "contract.mine",
            "dimension": "contract",
            "when": {"predicate": "contract.type_mismatch"},
            "verdict": "ineligible",
            "evidence": "Not my kind of contract",
        },
        {
            "id": "loc.emea_only",
            "dimension": "location",
            "when": {"any_phrase": ["emea only"]},
            "verdict": "ineligible",
            "evidence": "switched off",
            "enabled": False,
        },
    ],
}


def _merged() -> RuleSet:
    return load_rules().merge(parse_rules(USER_RULES))


@query(
    "load_rules",
    O.with_(
        "SELECT id, coalesce("
        + ", ".join(
            f"CASE WHEN {O.first_phrase('stext', r.any_phrase)} IS NOT NULL THEN {O.q(r.verdict)} END"
            for r in load_rules().rules
            if r.dimension == "authorisation"
        )
        + ", 'unknown') AS outcome FROM listings",
        "listings",
    ),
)
def loaded_rules(spark, sf):
    """The shipped authorisation rules as loaded."""
    auth = RuleSet(tuple(r for r in load_rules().rules if r.dimension == "authorisation"))
    return E.resolve_eligibility(L.listings(spark, sf), L.PROFILE, auth, L.NOW).select(
        "id", F.col("eligibility.eligibility").alias("outcome")
    )


_LOC = [r for r in load_rules().rules if r.dimension == "location" and r.id not in ("loc.emea_only", "loc.apac_only")]


@query(
    "merge_rules",
    O.with_(
        "SELECT id, CASE "
        + " ".join(
            f"WHEN {O.first_phrase('location_text' if r.id == 'loc.us_only' else 'stext', ['remote (us)'] if r.id == 'loc.us_only' else r.any_phrase)} "
            f"IS NOT NULL THEN {O.q(r.id)}"
            for r in _LOC
        )
        + " END AS location_rule, CASE WHEN contract_type NOT IN ('unknown', 'full_time', 'contract') THEN "
        "'Listing is ' || replace(contract_type, '_', ' ') || '; you accept full time, contract' END AS contract_evidence FROM listings",
        "listings",
    ),
)
def merge_rules(spark, sf):
    """A replaced rule keeps its place, a disabled one goes, a new one appends."""
    rows = E.resolve_eligibility(L.listings(spark, sf), L.PROFILE, _merged(), L.NOW)

    def of(dimension, field):
        hits = F.filter("eligibility.dimensions", lambda d: d["dimension"] == dimension)
        return F.get(hits, F.lit(0))[field]

    return rows.select("id", of("location", "rule_id").alias("location_rule"), of("contract", "evidence").alias("contract_evidence"))


# --- predicates ---


def _fires(name: str) -> str:
    return f"SELECT id, evidence FROM dims WHERE source_field = '{name}'"


def _predicate(spark, sf, column):
    rows = L.listings(spark, sf).withColumn("stext", E.scope_fields(["title", "company", "location_text", "description"]))
    return rows.select("id", column.alias("evidence")).filter(F.col("evidence").isNotNull())


@query("pred_timezone_insufficient_overlap", O.with_(_fires("timezone.insufficient_overlap"), "dims"))
def insufficient(spark, sf):
    return _predicate(spark, sf, P.insufficient_overlap(F.col("stext"), L.PROFILE, L.NOW))


@query("pred_timezone_sufficient_overlap", O.with_(_fires("timezone.sufficient_overlap"), "dims"))
def sufficient(spark, sf):
    return _predicate(spark, sf, P.sufficient_overlap(F.col("stext"), L.PROFILE, L.NOW))


@query(
    "pred_contract_type_mismatch",
    O.with_(
        "SELECT id, 'Listing is ' || replace(contract_type, '_', ' ') || '; you accept full time, contract' AS evidence "
        "FROM listings WHERE contract_type NOT IN ('unknown', 'full_time', 'contract')",
        "listings",
    ),
)
def contract_mismatch(spark, sf):
    return _predicate(spark, sf, P.contract_mismatch(L.PROFILE))


@query("pred_currency_unsupported", O.with_(_fires("currency.unsupported"), "dims"))
def currency(spark, sf):
    return _predicate(spark, sf, P.unsupported_currency(L.PROFILE))


@query(
    "overlap_hours",
    f"SELECT c_custkey, CAST({O.shared_hours('a', 'b')} AS DOUBLE) AS hours "
    "FROM (SELECT c_custkey, (c_nationkey % 25) - 11 AS a, c_custkey % 27 - 12 + 0.5 AS b FROM customer)",
)
def overlap_hours(spark, sf):
    """Two derived UTC offsets per customer."""
    a = ((F.col("c_nationkey") % 25) - 11).cast("double")
    b = (F.col("c_custkey") % 27 - 12 + 0.5).cast("double")
    return L.table(spark, sf, "customer").select("c_custkey", clocks.overlap_hours(a, b).alias("hours"))


@query(
    "stated_zone",
    O.with_("SELECT id, required_hours, stated_zone FROM (SELECT id, " + O.clock_columns("stext") + " FROM listings) WHERE required_hours IS NOT NULL", "listings"),
)
def stated_zone(spark, sf):
    rows = L.listings(spark, sf).withColumn("stext", E.scope_fields(["title", "company", "location_text", "description"]))
    found = rows.select("id", clocks.required_hours(F.col("stext")).alias("required_hours"), clocks.stated_zone(F.col("stext")).alias("stated_zone"))
    return found.filter(F.col("required_hours").isNotNull())




BERLIN_PROFILE = replace(L.PROFILE, country="DE", timezone="Europe/Berlin", currencies=("EUR",), work_authorisation=("EU",))
MANY = {"india": (L.PROFILE, O.MY_OFFSET), "us": (US_PROFILE, "-8"), "berlin": (BERLIN_PROFILE, "1"), "india_too": (L.PROFILE, O.MY_OFFSET)}


@query(
    "resolve_profiles",
    O.with_(
        " UNION ALL ".join(
            f"SELECT {O.q(name)} AS profile, {DIMS} FROM ({O.dimension_rows('listings', profile, offset)}) WHERE eligibility <> 'unknown'"
            for name, (profile, offset) in MANY.items()
        ),
        "listings",
    ),
)
def resolve_profiles(spark, sf):
    """Four profiles of three classes from one scan of the texts."""
    rows, path = L.listings(spark, sf), scratch_dir(spark)
    PR.hit_table(rows, load_rules()).write.parquet(path)
    return PR.resolve_profiles(rows, {n: p for n, (p, _) in MANY.items()}, load_rules(), L.NOW, hits=spark.read.parquet(path))


_READ = "title, company, location_text, description, contract_type, pay_min, pay_max, pay_currency, pay_period"


@query(
    "relabel_changed",
    O.with_(
        f"SELECT n.id, v.verdict AS eligibility, NOT EXISTS (SELECT 1 FROM listings o WHERE {' AND '.join(f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in _READ.split(', '))}) AS fresh "
        "FROM listings2 n JOIN later v USING (id)",
        "listings",
        "listings2",
        dims=O.dimension_rows("listings2"),
        later=O.VERDICT,
    ),
)
def relabel_changed(spark, sf):
    """A second scrape, labelled where the first one's verdicts do not serve."""
    root, rules = scratch_dir(spark), load_rules()
    second = unique_listings(L.second_scrape(spark, sf), L.NOW)
    ME.label_new(L.listings(spark, sf), None, L.PROFILE, rules, L.NOW).write.parquet(f"{root}/run=1")
    known = spark.read.parquet(f"{root}/run=1")
    ME.label_new(second, known, L.PROFILE, rules, L.NOW).write.parquet(f"{root}/run=2")
    new = spark.read.parquet(f"{root}/run=2")
    memo = known.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    keyed = second.select("id", ME.verdict_key().alias("verdict_key"))
    return keyed.join(memo, "verdict_key").select("id", F.col("eligibility.eligibility").alias("eligibility"), "fresh")
