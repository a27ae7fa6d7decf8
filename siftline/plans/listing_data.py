"""Listings derived from the given tables.

The tables hold no job listings, so one SQL text derives them from
``documents``: every document becomes a listing whose remaining fields follow
from its number. The same text runs in Spark and in the checking database, over
the whole table.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.eligibility import resolve_eligibility
from siftline.operators.normalise import unique_listings
from siftline.operators.rules import load_rules
from siftline.schema import Profile, criteria_from_profile

NOW = datetime(2026, 3, 1, 12, 0, 0, tzinfo=timezone.utc)
PROFILE = Profile(
    country="IN",
    timezone="Asia/Kolkata",
    contract_types=("full_time", "contract"),
    currencies=("USD", "EUR", "GBP"),
    skills=("Python", "TypeScript", "PostgreSQL", "AWS", "Docker"),
    titles=("Senior Software Engineer", "Backend Engineer", "Platform Engineer"),
    seniority="senior",
    resume_text="Backend engineer, eight years of Python and PostgreSQL on AWS.",
)
CRITERIA = criteria_from_profile(PROFILE)


def _turns(expressions: list[str]) -> str:
    """One of the SQL expressions, in turn."""
    whens = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expressions))
    return f"CASE doc_id % {len(expressions)} {whens} END"


def _cycle(values: list[str | None]) -> str:
    return _turns(["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values])


def _number(least: int, span: int, digits: int = 0) -> str:
    """A number from ``least`` on as text, padded with zeros where it has ``digits``."""
    text = f"CAST({least} + doc_id % {span} AS STRING)"
    return f"lpad({text}, {digits}, '0')" if digits else text


TITLES = [
    "Senior Backend Engineer", "Platform Engineer (Kubernetes)", "Technical Recruiter", "Staff Software Engineer",
    "Internal Tools Engineer", "Data  Engineer", "Engineering Manager", " ", "Frontend Developer",
]
LOCATIONS = ["Remote", "Remote (US)", "Remote - Worldwide", "EMEA only", None, "Remote - Europe", "Remote"]
# Texts whose figures follow from the document's number.
PAY = [
    f"concat('$', {_number(100, 89)}, ',', {_number(0, 991, 3)}, ' - $', {_number(190, 97)}, ',000 per year')",
    f"concat('$', {_number(40, 83)}, ' per hour')",
    f"concat({_number(90, 61)}, 'k-', {_number(151, 53)}, 'k USD')",
    f"concat('Competitive salary, team of ', {_number(2, 97)})",
    "NULL",
    f"concat({_number(1, 19)}, '+ years experience')",
    f"concat({_number(50, 71)}, ',', {_number(0, 983, 3)}, ' EUR per year')",
    f"concat('£', {_number(30, 67)}, 'k')",
    f"concat('₹', {_number(10, 59)}, ',', {_number(0, 97, 2)}, ',000 per annum')",
    f"concat('$', {_number(10, 43)}, ' per hour')",
]
CONTRACTS = [
    "'full_time'", f"concat('contract, ', {_number(1, 35)}, ' months')", f"concat('Part-time ', {_number(8, 31)}, 'h')", "NULL",
    f"concat('Internship ', {_number(1, 997)})", f"concat('FullTime ', {_number(1, 991)})",
]
POSTED = [
    f"concat({_number(1, 53)}, ' days ago')",
    f"concat('2026-02-', {_number(1, 27, 2)}, 'T', {_number(0, 23, 2)}, ':', {_number(0, 59, 2)}, ':00Z')",
    "CAST(1740830400 + doc_id * 61 AS STRING)",
    "CAST((1740830400 + doc_id * 61) * 1000 AS STRING)",
    f"concat('Fri, 20 Feb 2026 ', {_number(0, 23, 2)}, ':', {_number(0, 59, 2)}, ':48 +0000')",
    "NULL",
    "'yesterday'",
    f"concat({_number(1, 5)}, ' months ago')",
]
TAGS = [f"concat(' Python|backend|python|Skill ', {_number(1, 997)})", "''"]
ENDINGS = [
    "Work from anywhere", "US  only", "we report status to us", "no visa sponsorship", "employer of record",
    "Requires 6 hours of overlap with PST.", "Requires 2 hours of overlap with CET.", "registration fee",
    "no experience required", "no experience required guaranteed income", "Python and Docker", "C++ and C#",
    "Python on AWS with PostgreSQL",
]

KEY = "CAST(CASE WHEN doc_id % 5 = 4 THEN doc_id - 1 ELSE doc_id END AS STRING)"
RAW_SQL = f"""
SELECT
  doc_id,
  source,
  CAST(substr(source, 4) AS INT) AS source_priority,
  doc_id AS ingest_pos,
  concat(
    CASE WHEN doc_id % 3 = 0 THEN 'HTTPS://Jobs.Example.com/roles/' ELSE 'https://jobs.example.com/roles/' END,
    {KEY},
    {_cycle(['', '/', '?utm_source=feed', '#top'])}
  ) AS url,
  CAST(doc_id AS STRING) AS external_id,
  {_cycle(TITLES)} AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('Company ', CAST(doc_id % 37 AS STRING)) END AS company,
  {_cycle(LOCATIONS)} AS location_text,
  {_turns(PAY)} AS compensation_text,
  {_turns(CONTRACTS)} AS contract_text,
  {_turns(POSTED)} AS posted_at_text,
  {_turns(TAGS)} AS tags_text,
  concat(text, ' ', {_cycle(ENDINGS)}) AS description
FROM documents
"""

# A later scrape: every 19th listing is gone, every 17th has a new title.
SECOND_SQL = f"""
SELECT * REPLACE (CASE WHEN doc_id % 17 = 0 AND trim(title) <> '' THEN concat(title, ' II') ELSE title END AS title)
FROM ({RAW_SQL}) WHERE doc_id % 19 <> 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.withColumn("tags", F.split("tags_text", r"\|")).drop("tags_text")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, RAW_SQL)


def second_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = raw_listings(spark, sf_dir).filter(F.col("doc_id") % 19 != 0)
    retitled = (F.col("doc_id") % 17 == 0) & (F.trim("title") != "")
    return first.withColumn("title", F.when(retitled, F.concat("title", F.lit(" II"))).otherwise(F.col("title")))


def listings(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalised and deduplicated; ``ingest_pos`` order within ``source_priority``."""
    rows = raw_listings(spark, sf_dir) if raw is None else raw
    return unique_listings(rows, NOW, keep=keep)


def labelled(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return resolve_eligibility(listings(spark, sf_dir, keep=keep), PROFILE, load_rules(), NOW)


def user_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, status, notes, eligibility_override)`` from the labels table."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.lit("dismissed")).otherwise(F.lit("new")).alias("status"),
        F.when(d % 6 == 0, F.concat(F.lit("note "), d.cast("string"))).alias("notes"),
        F.when(F.col("quality") == 0, F.lit("ineligible")).when(d % 4 == 0, F.lit("eligible")).alias("eligibility_override"),
    )


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled listings with the user's columns, keyed by ``doc_id`` too."""
    labels = labelled(spark, sf_dir, keep=("doc_id",))
    joined = labels.join(user_columns(spark, sf_dir), "doc_id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit("new")),
            "verification": F.lit(None).cast("struct<tier:string,reasons:array<string>,checked_at:timestamp,http_status:int>"),
            "prescore": F.lit(None).cast("double"),
            "match": F.lit(None).cast("struct<score:int,reason:string,gaps:array<string>,provider:string,scored_at:timestamp>"),
        }
    )
