from __future__ import annotations

import copy
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftline.functions import clocks
from siftline.functions.patterns import any_phrase, phrase
from siftline.operators import eligibility as E
from siftline.operators.rulebook import DEFAULT_RULES
from siftline.operators.rules import RuleError, RuleSet, load_rules, parse_rules, read_rules
from siftline.plans.listing_data import NOW, PROFILE

US = replace(PROFILE, country="us", timezone="America/Los_Angeles", work_authorisation=("US",))
LISTING = "id string, title string, company string, location_text string, description string, contract_type string, compensation struct<currency:string>"


def verdicts(spark, rows, profile=PROFILE, rules=None):
    """``{id: verdict row}`` for ``(description, location, contract, currency)``."""
    data = [(str(i), "Engineer", "Acme", r[1], r[0], r[2], (r[3],)) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, LISTING)
    labelled = E.resolve_eligibility(frame, profile, load_rules() if rules is None else rules, NOW)
    out = labelled.select("id", "eligibility", E.summary(F.col("eligibility")).alias("summary")).collect()
    return [r for r in sorted(out, key=lambda r: int(r["id"]))]


def texts(spark, *descriptions, **kw):
    return verdicts(spark, [(d, None, "unknown", None) for d in descriptions], **kw)


def test_word_boundaries_and_whitespace(spark):
    got = texts(
        spark,
        "Report status to us weekly and we will discuss priorities.",
        "US\nonly please",
        "REMOTE (US) role",
        "statUS ONLY",
    )
    assert [r["eligibility"]["eligibility"] for r in got] == ["unknown", "ineligible", "ineligible", "unknown"]
    assert got[1]["eligibility"]["dimensions"][0]["matched_text"] == "US\nonly"


def test_unknown_is_never_ineligible(spark):
    got = texts(spark, "We build things.", "")
    assert [r["eligibility"]["eligibility"] for r in got] == ["unknown", "unknown"]
    assert got[0]["summary"] == "Could not determine eligibility from the listing"


def test_determined_verdicts_are_explained(spark):
    for row in texts(spark, "us only", "work from anywhere", "green card", "Requires 6 hours of overlap with PST."):
        for d in row["eligibility"]["dimensions"]:
            assert (d["eligibility"] == "unknown") == (d["rule_id"] is None) == (d["evidence"] is None)


def test_exempt_profile(spark):
    row = ("", "Remote — US only", "unknown", None)
    assert verdicts(spark, [row])[0]["eligibility"]["eligibility"] == "ineligible"
    assert verdicts(spark, [row], profile=US)[0]["eligibility"]["eligibility"] != "ineligible"


def test_first_declared_rule_and_phrase_win(spark):
    dims = texts(spark, "us only, but work from anywhere, remote worldwide first")[0]["eligibility"]["dimensions"]
    assert (dims[0]["rule_id"], dims[0]["matched_text"]) == ("loc.worldwide", "work from anywhere")


def test_combination(spark):
    got = texts(spark, "work from anywhere. no visa sponsorship.")[0]
    assert got["eligibility"]["eligibility"] == "ineligible"
    assert got["summary"] == "Listing states visa sponsorship is not available"


def test_overlap_predicates(spark):
    got = texts(
        spark,
        "Requires 6 hours of overlap with PST.",
        "Requires 4 hours of overlap with CET.",
        "Requires 4 hours of overlap with NZDT.",
        "overlap of at least 3 hrs, eastern time",
        "6 hours of overlap. " + "x" * 200 + " PST",
    )
    tz = [r["eligibility"]["dimensions"][2] for r in got]
    assert [d["eligibility"] for d in tz] == ["ineligible", "eligible", "eligible", "ineligible", "eligible"]
    assert tz[0]["evidence"].startswith("Requires 6h overlap with PST; your timezone (Asia/Kolkata) gives about 0.0h")
    assert tz[1]["evidence"] == "Stated overlap requirement of 4h is satisfiable"


def test_unknown_user_zone_gives_no_blocker(spark):
    got = texts(spark, "Requires 6 hours of overlap with PST.", profile=replace(PROFILE, timezone="Mars/Base"))
    assert got[0]["eligibility"]["eligibility"] == "eligible"


def test_currency(spark):
    got = verdicts(spark, [("", None, "unknown", "INR"), ("", None, "unknown", "usd"), ("", None, "unknown", None)])
    assert [r["eligibility"]["eligibility"] for r in got] == ["ineligible", "unknown", "unknown"]
    assert got[0]["summary"] == "Pay quoted in INR; you accept EUR, GBP, USD"


def test_no_rules_means_unknown(spark):
    got = texts(spark, "us only", rules=RuleSet(()))[0]["eligibility"]
    assert (got["eligibility"], got["dimensions"]) == ("unknown", [])


def test_scope_and_all_phrases(spark):
    rules = parse_rules(
        {
            "version": 1,
            "rules": [
                {
                    "id": "a.b", "dimension": "location", "verdict": "ineligible", "evidence": "e",
                    "when": {"all_phrases": ["remote", "berlin"], "fields": ["location_text"]},
                }
            ],
        }
    )
    rows = [("berlin remote", None, "unknown", None), ("", "Remote, Berlin", "unknown", None), ("berlin", "remote", "unknown", None)]
    got = verdicts(spark, rows, rules=rules)
    assert [r["eligibility"]["eligibility"] for r in got] == ["unknown", "ineligible", "unknown"]
    assert got[1]["eligibility"]["dimensions"][0]["matched_text"] == "Remote"


def test_screen_matches_exactly_when_a_phrase_does(spark):
    phrases = [p for r in load_rules().rules for p in r.any_phrase]
    samples = phrases + [p.replace(" ", "  \n") for p in phrases] + ["x" + p for p in phrases] + [p + "x" for p in phrases] + [p[:-1] for p in phrases]
    frame = spark.createDataFrame([(s,) for s in samples], "t string")
    each = F.lit(False)
    for p in phrases:
        each = each | F.col("t").rlike(phrase(p))
    assert frame.filter(each != F.col("t").rlike(any_phrase(phrases))).count() == 0


def test_offsets_column_agrees_with_the_driver(spark):
    zones = ["Asia/Kolkata", "America/Los_Angeles", "UTC", "Mars/Base", None]
    rows = spark.createDataFrame([(i, z) for i, z in enumerate(zones)], "i int, z string")
    got = [r["o"] for r in rows.select("i", clocks.utc_offset_hours_column(F.col("z"), NOW).alias("o")).orderBy("i").collect()]
    assert got == [None if z is None else clocks.utc_offset_hours(z, NOW) for z in zones]


# --- loading ---


def changed(**edits):
    data = copy.deepcopy(DEFAULT_RULES)
    data["rules"][0].update(edits)
    return data


@pytest.mark.parametrize(
    "data",
    [
        [],
        {"rules": []},
        {"version": 2, "rules": []},
        {"version": 1, "rules": {}},
        {"version": 1, "rules": [], "more": 1},
        changed(id="Bad"),
        changed(id="loc.us_only"),
        changed(verdict="unknown"),
        changed(dimension="age"),
        changed(evidence=""),
        changed(extra=1),
        changed(when={}),
        changed(when={"any_phrase": [" "]}),
        changed(when={"any_phrase": "us only"}),
        changed(when={"any_phrase": ["x"], "fields": ["salary"]}),
        changed(when={"predicate": "no.such"}),
        changed(unless_profile_matches={"city": ["x"]}),
    ],
)
def test_malformed_rules_are_fatal(data):
    with pytest.raises(RuleError):
        parse_rules(data)


def test_merge_keeps_place_and_appends():
    mine = parse_rules({"version": 1, "rules": [dict(DEFAULT_RULES["rules"][2], evidence="mine"), dict(DEFAULT_RULES["rules"][0], id="my.rule")]})
    merged = load_rules().merge(mine)
    assert merged.rules[2].evidence == "mine"
    assert [r.id for r in merged.rules[:-1]] == [r.id for r in load_rules().rules]
    assert merged.rules[-1].id == "my.rule"


def test_rule_files(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"version": 1, "rules": [dict(DEFAULT_RULES["rules"][2], enabled=False)]}))
    assert "loc.us_only" not in [r.id for r in load_rules(path).enabled]
    assert load_rules(tmp_path / "absent.json") == load_rules()
    path.write_text("{")
    with pytest.raises(RuleError):
        read_rules(path)
    with pytest.raises(RuleError):
        read_rules(tmp_path / "absent.json")


def test_possible_phrases_miss_none(spark):
    """Wherever a pattern finds a phrase, the screen by words lets it through."""
    phrases = ["us only", "u.s. citizens", "work from anywhere", "c++", "(kiosk)", "no visa sponsorship", "über only", "---"]
    pieces = ["US", "us", "u\u017f", "U.S.", "citizens", "c\u0131t\u0130zen\u017f", "work", "wor\u212a", "FROM", "anywhere", "only", "C++", "(kiosk)", "(\u212aio\u017fk)", "---", "ÜBER", "bus", "no_visa", "visa\u00a0sponsorship", "no"]
    texts = [sep.join(p) for a in pieces for b in pieces for sep in (" ", "\n", "_", "é") for p in [(a, b), (a, "from", b)]] + ["", "é"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select("*", E.possible_phrases(F.col("t"), phrases).alias("possible"), *[F.col("t").rlike(phrase(p)).alias(f"p{i}") for i, p in enumerate(phrases)])
    rows = found.collect()
    met = 0
    for row in rows:
        for i, p in enumerate(phrases):
            met += row[f"p{i}"]
            assert not row[f"p{i}"] or p in row["possible"], (row["t"], p)
    assert met > 100
    # And it keeps most patterns from running at all.
    assert sum("us only" in r["possible"] for r in rows) < len(rows) / 4


def test_no_other_letter_matches_an_ascii_one(spark):
    """The letters that the screen replaces are all that a pattern takes for ASCII's."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [(chr(i),) for i in range(128, 0x11000) if not 0xD800 <= i < 0xE000]
    frame = spark.createDataFrame(codes, "c string")
    got = {r["c"] for r in frame.filter(F.col("c").rlike(f"(?iU)[{letters}]") | F.lower("c").rlike("[a-z0-9]")).collect()}
    assert got == set(E.LOOKALIKES[0])
