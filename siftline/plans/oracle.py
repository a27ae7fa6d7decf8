"""SQL counterparts of the operators, for checking results in another engine.

Written independently of the Spark expressions, in the dialect of the checking
database (RE2 patterns, list lambdas). Only data is shared: phrases, tables of
constants and the text that derives listings from ``documents``.
"""

from __future__ import annotations

import re

from siftline.functions import clocks, pay, urls
from siftline.operators import ranking, verification
from siftline.operators.rules import load_rules
from siftline.plans.listing_data import CRITERIA, NOW, PROFILE, RAW_SQL, SECOND_SQL

NOW_EPOCH = int(NOW.timestamp())
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_CHARS = " || ".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case(key: str, table: dict, quote: bool = True) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if quote else v}" for k, v in table.items())
    return f"CASE {key} {whens} END"


def strip(c: str) -> str:
    return f"trim({c}, {SPACE_CHARS})"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(SPACE + '+')}, ' ', 'g'), ' ')"


def blank_lines(c: str) -> str:
    return f"regexp_replace({c}, {q(chr(10) + SPACE + '*' + chr(10) + SPACE + '*')}, chr(10) || chr(10), 'g')"


def html_text(c: str) -> str:
    """Markup of the given pages: no self-closed tags, four named entities."""
    hidden = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<![^>]*>"
    tags = ("p", "div", "br", "li", "tr", "h[1-6]", "section", "article", "ul", "ol", "table", "blockquote")
    blocks = rf"(?i)</?(?:{'|'.join(tags)})(?:\s[^>]*)?>"
    text = f"regexp_replace({c}, {q(hidden)}, '', 'g')"
    text = f"regexp_replace({text}, {q(blocks)}, chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        text = f"replace({text}, '{name}', {q(char)})"
    # An ampersand may lack its semicolon in these pages; it is decoded last.
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    spaced = f"regexp_replace({text}, '[ \\t\\r\\f\\x0b]+', ' ', 'g')"
    return f"CASE WHEN contains({c}, '<') THEN {strip(blank_lines(spaced))} ELSE {blank_lines(strip(c))} END"


def sha16(c: str) -> str:
    return f"substr(sha256({c}), 1, 16)"


_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical(u: str) -> str:
    def part(n: int) -> str:
        return f"regexp_extract({u}, {q(_URL)}, {n})"

    def enc(c: str) -> str:
        return f"replace(url_encode({c}), '%20', '+')"

    pairs = (
        f"list_transform(list_filter(string_split({part(4)}, '&'), lambda p: regexp_matches(p, '(?s)=.')), "
        "lambda p: {'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), "
        "'v': url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))})"
    )
    kept = f"list_sort(list_filter({pairs}, lambda x: NOT list_contains({strings(urls.TRACKING_PARAMS)}, lower(x.k))))"
    query = f"array_to_string(list_transform({kept}, lambda x: {enc('x.k')} || '=' || {enc('x.v')}), '&')"
    path = f"coalesce(nullif(rtrim({part(3)}, '/'), ''), '/')"
    return (
        f"(lower({part(1)}) || '://' || lower({part(2)}) || {path} || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )


# --- pay ---
_AMOUNT = (
    r"(US\$|C\$|A\$|S\$|[$£€₹])?\s*(\d{1,2}(?:,\d{2})+,\d{3}|\d{1,3}(?:[,\s]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
    r"(?:\s*([kKmM])\b)?"
)


def pay_part(t: str, group: int) -> str:
    return f"list_transform(regexp_extract_all({t}, {q(_AMOUNT)}, {group}), lambda x: coalesce(x, ''))"


def amounts(t: str) -> str:
    """List of DOUBLE figures."""
    values = (
        f"list_transform(range(1, len({pay_part(t, 2)}) + 1), lambda i: {{"
        f"'v': CAST(replace(replace({pay_part(t, 2)}[i], ',', ''), ' ', '') AS DOUBLE) * "
        f"CASE lower({pay_part(t, 3)}[i]) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END, "
        f"'m': {pay_part(t, 1)}[i] <> '' OR {pay_part(t, 3)}[i] <> ''}})"
    )
    return (
        f"list_transform(list_filter({values}, lambda a: a.v > 0 AND "
        "(a.m OR (a.v >= 1000 AND NOT (a.v BETWEEN 1900 AND 2100)))), lambda a: a.v)"
    )


def currency(t: str) -> str:
    symbol = f"lower(list_filter({pay_part(t, 1)}, lambda s: s <> '')[1])"
    code = f"nullif(upper(regexp_extract({t}, {q(r'(?i)\b(' + '|'.join(pay.CODES) + r')\b')}, 1)), '')"
    return f"coalesce({case(symbol, pay.SYMBOLS)}, {code})"


def period(t: str, largest: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {q('(?i)' + hint)}) THEN {q(name)}" for name, hint in pay.PERIOD_HINTS)
    return f"CASE {whens} WHEN {largest} < 2000 THEN 'hourly' ELSE 'yearly' END"


def posted_epoch(t: str) -> str:
    unit = case(f"lower(regexp_extract({t}, '(?i)([0-9]+)\\s*(second|minute|hour|day|week|month|year)s?\\s*ago', 2))",
                {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}, quote=False)
    return (
        f"CASE WHEN regexp_matches({t}, '(?i)[0-9]+\\s*(second|minute|hour|day|week|month|year)s?\\s*ago') "
        f"THEN {NOW_EPOCH} - TRY_CAST(regexp_extract({t}, '[0-9]+', 0) AS BIGINT) * {unit} "
        f"WHEN regexp_matches({t}, '^[0-9]{{9,}}$') THEN "
        f"CASE WHEN TRY_CAST({t} AS BIGINT) > 4102444800 THEN TRY_CAST({t} AS BIGINT) // 1000 ELSE TRY_CAST({t} AS BIGINT) END "
        f"WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(epoch(TRY_CAST({t} AS TIMESTAMPTZ)) AS BIGINT) "
        f"ELSE CAST(epoch(try_strptime(regexp_replace({t}, '^[A-Za-z]{{3}}, ', ''), '%d %b %Y %H:%M:%S %z')) AS BIGINT) END"
    )


def contract(*values: str) -> str:
    hay = f"concat_ws(' ', {', '.join(values)})"
    return (
        f"CASE WHEN regexp_matches({hay}, '(?i)\\b(intern|internship)\\b') THEN 'internship' "
        f"WHEN regexp_matches({hay}, '(?i)\\b(contract|contractor|freelance|b2b|consulting)\\b') THEN 'contract' "
        f"WHEN regexp_matches({hay}, '(?i)\\bpart[\\s-]?time\\b') THEN 'part_time' "
        f"WHEN regexp_matches({hay}, '(?i)\\bfull[\\s-]?time\\b') THEN 'full_time' ELSE 'unknown' END"
    )


def normalised(source: str) -> str:
    """All usable rows of a raw relation, in canonical form."""
    return f"""
SELECT *, {sha16('url')} AS id,
  len(pay_amounts) AS pay_n,
  {sha16("lower(title || ' ' || coalesce(" + collapse('company') + ", '') || ' ' || " + collapse('description') + ")")} AS content_hash
FROM (
  SELECT doc_id, source, source_priority, ingest_pos, external_id,
    {collapse("coalesce(title, '')")} AS title,
    {canonical(strip('url'))} AS url,
    nullif({collapse('company')}, '') AS company,
    nullif({collapse('location_text')}, '') AS location_text,
    {html_text('description')} AS description,
    compensation_text, contract_text, posted_at_text,
    {amounts('compensation_text')} AS pay_amounts,
    {contract('contract_text', "title", "nullif(array_to_string(string_split(tags_text, '|'), ' '), '')")} AS contract_type,
    list_sort(list_distinct(list_filter(list_transform(string_split(tags_text, '|'), lambda t: lower({strip('t')})), lambda t: t <> ''))) AS tags,
    {posted_epoch(strip('posted_at_text'))} AS posted_epoch
  FROM ({source})
) WHERE title <> '' AND regexp_matches(url, '^https?://[^/]')
"""


def unique(relation: str) -> str:
    return f"SELECT * FROM {relation} QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_priority, ingest_pos) = 1"


PAY_COLUMNS = f"""
  list_min(pay_amounts) AS pay_min,
  CASE WHEN pay_n > 1 THEN list_max(pay_amounts) END AS pay_max,
  CASE WHEN pay_n > 0 THEN {currency('compensation_text')} END AS pay_currency,
  CASE WHEN pay_n > 0 THEN {period('compensation_text', 'list_max(pay_amounts)')} END AS pay_period
"""


# --- eligibility ---
def phrase(text: str) -> str:
    lowered = text.lower()
    body = r"\s+".join(re.escape(w) for w in lowered.split()).replace(r"\ ", " ")
    return "(?i)" + (r"\b" if lowered[0].isalnum() else "") + body + (r"\b" if lowered[-1].isalnum() else "")


def first_phrase(t: str, phrases) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {q(phrase(p))}, 0), '')" for p in phrases) + ")"


FIRST, SECOND = "(?i)" + clocks.OVERLAP_THEN_HOURS, "(?i)" + clocks.HOURS_THEN_OVERLAP


def clock_columns(t: str) -> str:
    hit = f"coalesce(nullif(regexp_extract({t}, {q(FIRST)}, 0), ''), nullif(regexp_extract({t}, {q(SECOND)}, 0), ''))"
    hours = f"coalesce(nullif(regexp_extract({t}, {q(FIRST)}, 1), ''), nullif(regexp_extract({t}, {q(SECOND)}, 1), ''))"
    window = f"substr({t}, greatest(1, strpos({t}, {hit}) - 120), least(120, strpos({t}, {hit}) - 1) + length({hit}) + 120)"
    zones = "|".join(clocks.ABBREVIATIONS)
    return (
        f"{hours} AS required_hours, "
        f"nullif(lower(regexp_extract({window}, {q(r'(?i)\b(' + zones + r')\b')}, 1)), '') AS stated_zone"
    )


def shared_hours(a: str, b: str) -> str:
    """Half hours of the day, in UTC, that lie in both workdays, counted one by one."""
    inside = " AND ".join(f"(s / 2.0 + {o} + 48) % 24 >= 9 AND (s / 2.0 + {o} + 48) % 24 < 18" for o in (a, b))
    return f"(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN len(list_filter(range(48), lambda s: {inside})) / 2.0 END)"


# Offsets at NOW, which lies outside summer time on both sides.
OFFSETS = {
    "pst": -8, "pdt": -8, "pt": -8, "pacific": -8, "est": -5, "edt": -5, "et": -5, "eastern": -5,
    "mst": -7, "mdt": -7, "cet": 1, "cest": 1, "gmt": 0, "bst": 0, "utc": 0, "ist": 5.5, "aest": 11,
}
MY_OFFSET = "5.5"
SEARCHABLE = "concat_ws(chr(10), title, company, location_text, nullif(description, ''))"


def _message(zone: str) -> str:
    return (
        "'Requires ' || CAST(CAST(required_hours AS INTEGER) AS VARCHAR) || 'h overlap with ' || upper(stated_zone) || "
        f"'; your timezone ({zone}) gives about ' || format('{{:.1f}}', CAST(available AS DOUBLE)) || "
        "'h of standard working-hour overlap'"
    )


def dimension_rows(relation: str, profile=PROFILE, offset: str = MY_OFFSET) -> str:
    """``(id, ord, dimension, eligibility, rule_id, evidence, matched_text, source_field)``."""
    rules = load_rules()
    parts = []
    fields = "title,company,location_text,description"
    for i, dim in enumerate(rules.dimensions):
        active = [r for r in rules.enabled if r.dimension == dim and not r.exempts(profile)]
        if all(r.predicate is None for r in active):
            matches = ", ".join(f"{first_phrase('stext', r.any_phrase)} AS m{j}" for j, r in enumerate(active))

            def pick(values, active=active):
                return "CASE " + " ".join(f"WHEN m{j} IS NOT NULL THEN {v}" for j, v in enumerate(values)) + " END"

            parts.append(
                f"SELECT id, {i} AS ord, {q(dim)} AS dimension, "
                f"coalesce({pick([q(r.verdict) for r in active])}, 'unknown') AS eligibility, "
                f"{pick([q(r.id) for r in active])} AS rule_id, {pick([q(r.evidence) for r in active])} AS evidence, "
                f"{pick([f'm{j}' for j in range(len(active))])} AS matched_text, "
                f"{pick([q(fields) for _ in active])} AS source_field "
                f"FROM (SELECT id, {matches} FROM {relation})"
            )
        elif dim == "timezone":
            parts.append(
                f"SELECT id, {i} AS ord, 'timezone' AS dimension, "
                "CASE WHEN required_hours IS NULL THEN 'unknown' WHEN short THEN 'ineligible' ELSE 'eligible' END AS eligibility, "
                "CASE WHEN required_hours IS NULL THEN NULL WHEN short THEN 'tz.insufficient_overlap' ELSE 'tz.sufficient_overlap' END AS rule_id, "
                "said AS evidence, said AS matched_text, "
                "CASE WHEN required_hours IS NULL THEN NULL WHEN short THEN 'timezone.insufficient_overlap' ELSE 'timezone.sufficient_overlap' END AS source_field "
                "FROM (SELECT *, CASE WHEN required_hours IS NULL THEN NULL "
                f"WHEN short THEN {_message(profile.timezone)} "
                "ELSE 'Stated overlap requirement of ' || required_hours || 'h is satisfiable' END AS said "
                "FROM (SELECT *, coalesce(available < CAST(required_hours AS INTEGER), false) AS short "
                f"FROM (SELECT *, {shared_hours(offset, case('stated_zone', OFFSETS, quote=False))} AS available "
                f"FROM (SELECT id, {clock_columns('stext')} FROM {relation}))))"
            )
        else:
            wanted = sorted(profile.currencies)
            fires = f"pay_currency IS NOT NULL AND NOT list_contains({strings(wanted)}, pay_currency)"
            said = f"'Pay quoted in ' || pay_currency || '; you accept {', '.join(wanted)}'"
            parts.append(
                f"SELECT id, {i} AS ord, 'currency' AS dimension, "
                f"CASE WHEN {fires} THEN 'ineligible' ELSE 'unknown' END AS eligibility, "
                f"CASE WHEN {fires} THEN 'currency.unsupported' END AS rule_id, "
                f"CASE WHEN {fires} THEN {said} END AS evidence, CASE WHEN {fires} THEN {said} END AS matched_text, "
                f"CASE WHEN {fires} THEN 'currency.unsupported' END AS source_field FROM {relation}"
            )
    return " UNION ALL ".join(parts)


VERDICT = """
SELECT id,
  CASE WHEN bool_or(eligibility = 'ineligible') THEN 'ineligible' WHEN bool_or(eligibility = 'eligible') THEN 'eligible' ELSE 'unknown' END AS verdict,
  CASE WHEN bool_or(eligibility = 'ineligible') THEN string_agg(CASE WHEN eligibility = 'ineligible' THEN evidence END, '; ' ORDER BY ord)
       WHEN bool_or(eligibility = 'eligible') THEN string_agg(CASE WHEN eligibility = 'eligible' THEN evidence END, '; ' ORDER BY ord)
       ELSE 'Could not determine eligibility from the listing' END AS summary
FROM dims GROUP BY id
"""

USERS = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'dismissed' ELSE 'new' END AS status,
  CASE WHEN doc_id % 6 = 0 THEN 'note ' || CAST(doc_id AS VARCHAR) END AS notes,
  CASE WHEN quality = 0 THEN 'ineligible' WHEN doc_id % 4 = 0 THEN 'eligible' END AS eligibility_override
FROM labels
"""


def hourly(low: str = "pay_min", cur: str = "pay_currency", per: str = "pay_period") -> str:
    return f"({low} * {case(cur, pay.APPROX_USD, quote=False)} / {case(per, pay.PERIOD_HOURS, quote=False)})"


def signal_rows(t: str) -> str:
    """List of triggered ``{id, weight, reason}`` in declared order."""
    items = ", ".join(
        f"CASE WHEN regexp_matches({t}, {q('(?i)' + p)}) THEN {{'id': {q(i)}, 'weight': {w}, 'reason': {q(r)}}} END"
        for i, p, w, r in verification.SIGNALS
    )
    return f"list_filter([{items}], lambda s: s IS NOT NULL)"


def skill_hits(t: str) -> str:
    return " + ".join(
        f"CAST(regexp_matches(lower({t}), {q('(^|[^\\w+#])' + re.escape(s.lower()) + '($|[^\\w+#])')}) AS INTEGER)"
        for s in PROFILE.skills
    )


def prescore_parts() -> dict[str, str]:
    titles = " OR ".join(f"contains(lower(title), {q(t.lower())})" for t in PROFILE.titles)
    words = sorted({w for t in PROFILE.titles for w in t.lower().split() if len(w) > 3})
    age = f"(({NOW_EPOCH} - posted_epoch) / 86400.0)"
    return {
        "skills": f"least(1.0, ({skill_hits('stext')}) / {float(max(1, min(len(PROFILE.skills), ranking.SKILL_CAP)))})",
        "title": f"CASE WHEN {titles} THEN 1.0 WHEN list_has_any(regexp_extract_all(lower(title), '[a-z+#]+'), {strings(words)}) THEN 0.5 ELSE 0.0 END",
        "recency": f"CASE WHEN posted_epoch IS NULL THEN 0.5 WHEN {age} <= 7 THEN 1.0 WHEN {age} >= 60 THEN 0.0 ELSE 1.0 - ({age} - 7.0) / 53.0 END",
        "weight": "CASE effective WHEN 'eligible' THEN 1.0 WHEN 'unknown' THEN 0.6 ELSE 0.0 END",
    }


def drop_reason(criteria=CRITERIA, tier: str = "NULL") -> str:
    title_hit = " OR ".join(f"contains(lower(title), {q(p)})" for p in criteria.excluded_title_phrases)
    signal = " OR ".join(f"regexp_matches(lower(stext), {q(chr(92) + 'b' + re.escape(k.lower()) + chr(92) + 'b')})" for k in criteria.tech_keywords)
    whens = []
    if not criteria.include_dismissed:
        whens.append("WHEN status = 'dismissed' THEN 'status_dismissed'")
    if criteria.exclude_ineligible:
        whens.append("WHEN effective = 'ineligible' THEN 'ineligible'")
    if criteria.exclude_unknown_eligibility:
        whens.append("WHEN effective = 'unknown' THEN 'unknown_eligibility'")
    if criteria.excluded_tiers:
        whens.append(f"WHEN {tier} IN ({', '.join(q(t) for t in criteria.excluded_tiers)}) THEN 'verification'")
    if criteria.excluded_title_phrases:
        whens.append(f"WHEN {title_hit} THEN 'title_excluded'")
    if criteria.required_title_phrases:
        wanted = " OR ".join(f"contains(lower(title), {q(p.lower())})" for p in criteria.required_title_phrases)
        whens.append(f"WHEN NOT ({wanted}) THEN 'title_not_matched'")
    if criteria.max_age_days is not None:
        whens.append(f"WHEN posted_epoch < {NOW_EPOCH - 86400 * criteria.max_age_days} THEN 'too_old'")
    if criteria.contract_types:
        kinds = ", ".join(q(k) for k in criteria.contract_types)
        whens.append(f"WHEN contract_type <> 'unknown' AND contract_type NOT IN ({kinds}) THEN 'contract_type'")
    if criteria.min_hourly_rate_usd is not None:
        whens.append(f"WHEN {hourly()} < {criteria.min_hourly_rate_usd} THEN 'below_min_rate'")
    if criteria.require_tech_signal and criteria.tech_keywords:
        whens.append(f"WHEN NOT ({signal}) THEN 'no_signal'")
    return "CASE " + " ".join(whens) + " END" if whens else "NULL"


def _ctes() -> dict[str, str]:
    parts = prescore_parts()
    total = f"0.55 * {parts['skills']} + 0.25 * {parts['title']} + 0.10 * {parts['recency']} + 0.10 * {parts['weight']}"
    return {
        "raw": RAW_SQL,
        "raw2": SECOND_SQL,
        "norm": normalised("SELECT * FROM raw"),
        "norm2": normalised("SELECT * FROM raw2"),
        "listings": f"SELECT *, {PAY_COLUMNS}, {SEARCHABLE} AS stext FROM ({unique('norm')})",
        "listings2": f"SELECT *, {PAY_COLUMNS}, {SEARCHABLE} AS stext FROM ({unique('norm2')})",
        "dims": dimension_rows("listings"),
        "verdicts": VERDICT,
        "users": USERS,
        "curated": (
            "SELECT l.*, v.verdict, v.summary, coalesce(u.status, 'new') AS status, u.notes, u.eligibility_override, "
            "coalesce(u.eligibility_override, v.verdict) AS effective "
            "FROM listings l JOIN verdicts v USING (id) LEFT JOIN users u USING (doc_id)"
        ),
        "scored": f"SELECT *, round({total}, 6) AS prescore FROM curated",
    }


CTES = _ctes()
_NEEDS = {
    "norm": ("raw",),
    "norm2": ("raw2",),
    "listings": ("norm",),
    "listings2": ("norm2",),
    "dims": ("listings",),
    "verdicts": ("dims",),
    "curated": ("listings", "verdicts", "users"),
    "scored": ("curated",),
}


def with_(select: str, *names: str, **extra: str) -> str:
    """Prefix a SELECT with the named relations and everything they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(body)} {select}" if body else select
