"""URL identity, text conversion and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import contract, dates, pay, text, urls
from siftline.operators.dedupe import dedupe_first_wins
from siftline.operators.eligibility import effective_eligibility
from siftline.operators.normalise import normalise, rejects
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query


def _pages(spark, sf):
    return L.table(spark, sf, "pages")


@query("canonical_url", f"SELECT page_id, {O.canonical('url')} AS canonical FROM pages")
def canonical_url(spark, sf):
    return _pages(spark, sf).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("job_id", f"SELECT page_id, {O.sha16(O.canonical('url'))} AS id FROM pages")
def job_id(spark, sf):
    return _pages(spark, sf).select("page_id", urls.listing_id(urls.canonical_url(F.col("url"))).alias("id"))


@query("html_to_text", f"SELECT page_id, {O.html_text('html')} AS body FROM pages")
def html_to_text(spark, sf):
    return _pages(spark, sf).select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("collapse_whitespace", f"SELECT doc_id, {O.collapse('text')} AS body FROM documents")
def collapse_whitespace(spark, sf):
    return L.table(spark, sf, "documents").select("doc_id", text.collapse_whitespace(F.col("text")).alias("body"))


@query("collapse_blank_lines", f"SELECT doc_id, {O.blank_lines('text')} AS body FROM documents")
def collapse_blank_lines(spark, sf):
    return L.table(spark, sf, "documents").select("doc_id", text.collapse_blank_lines(F.col("text")).alias("body"))


@query(
    "content_hash",
    "SELECT doc_id, "
    + O.sha16("lower(source || '  ' || " + O.collapse("text") + ")")
    + " AS content_hash FROM documents",
)
def content_hash(spark, sf):
    """The source stands in for the title; a null company leaves its empty part."""
    hashed = text.content_hash(F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return L.table(spark, sf, "documents").select("doc_id", hashed.alias("content_hash"))


@query(
    "parse_amounts",
    O.with_(
        f"SELECT doc_id, i AS position, {O.amounts('compensation_text')}[i] AS amount "
        f"FROM (SELECT *, unnest(range(1, len({O.amounts('compensation_text')}) + 1)) AS i FROM raw)",
        "raw",
    ),
)
def parse_amounts(spark, sf):
    amounts = pay.parse_amounts(F.col("compensation_text"))
    exploded = L.raw_listings(spark, sf).select("doc_id", F.posexplode(amounts).alias("at", "value"))
    return exploded.select("doc_id", (F.col("at") + 1).cast("bigint").alias("position"), F.col("value").cast("double").alias("amount"))


@query("parse_compensation", O.with_(f"SELECT doc_id, {O.PAY_COLUMNS} FROM norm", "norm"))
def parse_compensation(spark, sf):
    rows = normalise(L.raw_listings(spark, sf), L.NOW, keep=("doc_id",))
    return rows.select("doc_id", *pay_columns())


def pay_columns():
    return [
        F.col("compensation.minimum").cast("double").alias("pay_min"),
        F.col("compensation.maximum").cast("double").alias("pay_max"),
        F.col("compensation.currency").alias("pay_currency"),
        F.col("compensation.period").alias("pay_period"),
    ]


@query("parse_currency", O.with_(f"SELECT doc_id, {O.currency('compensation_text')} AS currency FROM raw", "raw"))
def parse_currency(spark, sf):
    return L.raw_listings(spark, sf).select("doc_id", pay.parse_currency(F.col("compensation_text")).alias("currency"))


@query(
    "parse_period",
    O.with_(f"SELECT doc_id, {O.period('compensation_text', 'list_max(' + O.amounts('compensation_text') + ')')} AS period FROM raw", "raw"),
)
def parse_period(spark, sf):
    t = F.col("compensation_text")
    return L.raw_listings(spark, sf).select("doc_id", pay.parse_period(t, F.array_max(pay.parse_amounts(t))).alias("period"))


@query("parse_posted_at", O.with_(f"SELECT doc_id, {O.posted_epoch('posted_at_text')} AS posted_epoch FROM raw", "raw"))
def parse_posted_at(spark, sf):
    stamp = dates.parse_posted_at(F.col("posted_at_text"), L.NOW)
    return L.raw_listings(spark, sf).select("doc_id", F.unix_seconds(stamp).alias("posted_epoch"))


@query("parse_contract_type", O.with_(f"SELECT doc_id, {O.contract('contract_text', 'title')} AS contract_type FROM raw", "raw"))
def parse_contract_type(spark, sf):
    kind = contract.parse_contract_type(F.col("contract_text"), F.col("title"))
    return L.raw_listings(spark, sf).select("doc_id", kind.alias("contract_type"))


@query("normalise_tags", O.with_("SELECT doc_id, array_to_string(tags, ',') AS tags FROM norm", "norm"))
def normalise_tags(spark, sf):
    rows = normalise(L.raw_listings(spark, sf), L.NOW, keep=("doc_id",))
    return rows.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(
    "drop_unusable",
    O.with_(
        "SELECT doc_id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'blank_title' ELSE 'bad_url' END AS reject_reason "
        "FROM bad WHERE trim(coalesce(title, '')) = '' OR NOT regexp_matches(url, '(?i)^https?://')",
        "raw",
        bad="SELECT * REPLACE (CASE WHEN doc_id % 10 = 1 THEN regexp_replace(url, '(?i)https:', 'ftp:') ELSE url END AS url) FROM raw",
    ),
)
def drop_unusable(spark, sf):
    raw = L.raw_listings(spark, sf)
    url = F.when(F.col("doc_id") % 10 == 1, F.regexp_replace("url", "(?i)https:", "ftp:")).otherwise(F.col("url"))
    return rejects(raw.withColumn("url", url)).select("doc_id", "reject_reason")


NORMAL = (
    "doc_id, id, source, url, title, company, location_text, contract_type, content_hash, posted_epoch, "
    "array_to_string(tags, ',') AS tags, length(description) AS description_length"
)


def _canonical(df):
    return df.select(
        "doc_id", "id", "source", "url", "title", "company", "location_text", "contract_type", "content_hash",
        F.unix_seconds("posted_at").alias("posted_epoch"), F.array_join("tags", ",").alias("tags"),
        F.length("description").cast("bigint").alias("description_length"),
    )


@query("normalise", O.with_(f"SELECT {NORMAL} FROM norm", "norm"))
def normalise_all(spark, sf):
    return _canonical(normalise(L.raw_listings(spark, sf), L.NOW, keep=("doc_id",)))


@query("dedupe_first_wins", O.with_(f"SELECT {NORMAL} FROM listings", "listings"))
def dedupe(spark, sf):
    """Normalise everything, then keep the first of each id."""
    order = ("source_priority", "ingest_pos")
    return _canonical(dedupe_first_wins(normalise(L.raw_listings(spark, sf), L.NOW, keep=(*order, "doc_id")), order))


@query("unique_listings", O.with_(f"SELECT {NORMAL} FROM listings", "listings"))
def unique_listings(spark, sf):
    """The same rows, deduplicated before the text work."""
    return _canonical(L.listings(spark, sf, keep=("doc_id",)))


@query("searchable_text", O.with_("SELECT id, md5(stext) AS digest, length(stext) AS n_chars FROM listings", "listings"))
def searchable_text(spark, sf):
    joined = text.searchable_text()
    return L.listings(spark, sf).select("id", F.md5(joined).alias("digest"), F.length(joined).cast("bigint").alias("n_chars"))


@query("effective_eligibility", O.with_("SELECT id, effective FROM curated", "curated"))
def effective(spark, sf):
    value = effective_eligibility(F.col("eligibility_override"), F.col("eligibility"))
    return L.curated(spark, sf).select("id", value.alias("effective"))


@query(
    "format_compensation",
    O.with_(
        "SELECT id, CASE WHEN pay_min IS NOT NULL THEN coalesce(pay_currency || ' ', '') || "
        "CASE WHEN pay_max <> pay_min THEN s(pay_min) || '–' || s(pay_max) ELSE s(pay_min) END || "
        "coalesce('/' || regexp_replace(pay_period, 'ly$', ''), '') END AS shown FROM listings",
        "listings",
    )
    .replace("s(pay_min)", "(CASE WHEN pay_min >= 1000 THEN CAST(CAST(round(pay_min / 1000) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(CAST(pay_min AS BIGINT) AS VARCHAR) END)")
    .replace("s(pay_max)", "(CASE WHEN pay_max >= 1000 THEN CAST(CAST(round(pay_max / 1000) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(CAST(pay_max AS BIGINT) AS VARCHAR) END)"),
)
def format_compensation(spark, sf):
    return L.listings(spark, sf).select("id", pay.format_compensation(F.col("compensation")).alias("shown"))


@query(
    "relative_days",
    O.with_(
        "SELECT id, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 30 THEN CAST(days AS VARCHAR) || 'd ago' "
        "WHEN days IS NOT NULL THEN CAST(days // 30 AS VARCHAR) || 'mo ago' END AS age "
        f"FROM (SELECT id, CAST(floor(({O.NOW_EPOCH} - posted_epoch) / 86400.0) AS BIGINT) AS days FROM listings)",
        "listings",
    ),
)
def relative_days(spark, sf):
    return L.listings(spark, sf).select("id", dates.relative_days(F.col("posted_at"), L.NOW).alias("age"))


@query(
    "approx_hourly_usd",
    O.with_(f"SELECT id, round({O.hourly()}, 4) AS hourly_usd FROM listings", "listings"),
)
def approx_hourly_usd(spark, sf):
    return L.listings(spark, sf).select("id", F.round(pay.approx_hourly_usd(F.col("compensation")), 4).alias("hourly_usd"))
