"""The seven feeds: how each one's records become raw listings.

A reader takes the payload table and returns raw listings plus the order columns
used by first-wins deduplication. Field types change from record to record, so
records stay VARIANT until each field is read with its own coercion. A record
without a URL is dropped; every other field may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.coerce import as_epoch_millis, as_tags, as_text, at
from siftline.functions.text import decode_entities, first_line, html_to_text, strip, strip_or_null
from siftline.schema import RAW_LISTING
from siftline.sources import payloads as P

# --- Fixed values: thread title, shortest posting, item address ---
THREAD_TITLE = r"(?iU)ask\s+hn:.*who\s+is\s+hiring"
MIN_POSTING_CHARS = 100
ITEM_URL = "https://news.ycombinator.com/item?id="
# --- End of fixed values ------------------------------------------


def _raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """Project to the raw listing columns; unnamed ones are null.

    The payload's own company becomes ``board``, next to the listing's company.
    """
    typed = [
        F.col("source") if f.name == "source" else columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RAW_LISTING
    ]
    told = [c for c in ("problem", P.LANDED) if c in rows.columns]
    shaped = rows.select(*typed, F.col("company").alias("board"), "payload_id", "record_pos", *told)
    usable = F.col("url").isNotNull()
    return shaped.filter(usable | F.col("problem").isNotNull() if "problem" in told else usable)


def _json_feed(source: str, envelope: str | None, mapping: Callable[[Column], dict[str, Column]]):
    def opened(payloads: DataFrame) -> DataFrame:
        return P.open_json(payloads.filter(F.col("source") == source), envelope)

    def read(payloads: DataFrame) -> DataFrame:
        rows = P.records(opened(payloads))
        record = F.col("record")
        return _raw(rows, raw=F.to_json(record), **mapping(record))

    def problems(payloads: DataFrame) -> DataFrame:
        return P.problems(opened(payloads))

    def entries(payloads: DataFrame) -> DataFrame:
        record = F.col("record")
        return _raw(P.entries(opened(payloads)), raw=F.to_json(record), **mapping(record))

    return read, problems, entries


def _remoteok(r: Column) -> dict[str, Column]:
    # The notice element is recognised by its shape, wherever it stands.
    notice = at(r, "$.legal").isNotNull()
    return {
        "url": F.when(~notice, F.coalesce(as_text(r, "$.url"), as_text(r, "$.apply_url"))),
        "external_id": as_text(r, "$.id"),
        "title": as_text(r, "$.position"),
        "company": as_text(r, "$.company"),
        "description": as_text(r, "$.description"),
        "location_text": as_text(r, "$.location"),
        "compensation_text": as_text(r, "$.salary"),
        "posted_at_text": as_text(r, "$.date"),
        "tags": as_tags(r, "$.tags"),
    }


def _remotive(r: Column) -> dict[str, Column]:
    return {
        "url": as_text(r, "$.url"),
        "external_id": as_text(r, "$.id"),
        "title": as_text(r, "$.title"),
        "company": as_text(r, "$.company_name"),
        "description": as_text(r, "$.description"),
        "location_text": as_text(r, "$.candidate_required_location"),
        "compensation_text": as_text(r, "$.salary"),
        "contract_text": as_text(r, "$.job_type"),
        "posted_at_text": as_text(r, "$.publication_date"),
        "tags": as_tags(r, "$.tags"),
    }


def _greenhouse(r: Column) -> dict[str, Column]:
    return {
        "url": as_text(r, "$.absolute_url"),
        "external_id": as_text(r, "$.id"),
        "title": as_text(r, "$.title"),
        "company": F.col("company"),
        "description": decode_entities(as_text(r, "$.content")),
        "location_text": as_text(r, "$.location.name"),
        "posted_at_text": as_text(r, "$.updated_at"),
    }


def _lever(r: Column) -> dict[str, Column]:
    return {
        "url": F.coalesce(as_text(r, "$.hostedUrl"), as_text(r, "$.applyUrl")),
        "external_id": as_text(r, "$.id"),
        "title": as_text(r, "$.text"),
        "company": F.col("company"),
        "description": as_text(r, "$.description"),
        "location_text": as_text(r, "$.categories.location"),
        "compensation_text": as_text(r, "$.salaryRange"),
        "contract_text": as_text(r, "$.categories.commitment"),
        "posted_at": as_epoch_millis(r, "$.createdAt"),
    }


def _ashby(r: Column) -> dict[str, Column]:
    return {
        "url": F.coalesce(as_text(r, "$.jobUrl"), as_text(r, "$.applyUrl")),
        "external_id": as_text(r, "$.id"),
        "title": as_text(r, "$.title"),
        "company": F.coalesce(as_text(r, "$.organizationName"), F.col("company")),
        "description": as_text(r, "$.descriptionHtml"),
        "location_text": as_text(r, "$.location"),
        "compensation_text": F.coalesce(
            as_text(r, "$.compensationTierSummary"), as_text(r, "$.compensation.compensationTierSummary")
        ),
        "contract_text": as_text(r, "$.employmentType"),
        "posted_at_text": as_text(r, "$.publishedAt"),
    }


read_remoteok, problems_remoteok, entries_remoteok = _json_feed("remoteok", None, _remoteok)
read_remotive, problems_remotive, entries_remotive = _json_feed("remotive", "jobs", _remotive)
read_greenhouse, problems_greenhouse, entries_greenhouse = _json_feed("greenhouse", "jobs", _greenhouse)
read_lever, problems_lever, entries_lever = _json_feed("lever", None, _lever)
read_ashby, problems_ashby, entries_ashby = _json_feed("ashby", "jobs", _ashby)


# --- RSS ---------------------------------------------------------------------

_ITEM_FIELDS = ("title", "region", "category", "type", "description", "pubDate", "link", "guid", "company")
# Every child may repeat; the first one with text counts.
_ITEM = "struct<" + ",".join(f"{n}:array<string>" for n in _ITEM_FIELDS) + ">"
_RSS = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, _broken string"


def _open_rss(payloads: DataFrame) -> DataFrame:
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    chosen = payloads.filter(F.col("source") == "weworkremotely")
    parsed = chosen.withColumn("_rss", F.from_xml("body", _RSS, options))
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.col("_rss").isNull() | F.col("_rss._broken").isNotNull(), F.lit("malformed RSS")
    )
    none = F.array().cast(f"array<{_ITEM}>")
    items = F.coalesce(F.col("_rss.channel.item"), F.col("_rss.item"), none)
    return parsed.withColumns({"problem": problem, "records": F.when(problem.isNull(), items)}).drop("_rss")


def split_headline(headline: Column) -> tuple[Column, Column]:
    """``(company, title)`` of ``Company: Title``, cut at the first colon.

    Without a colon, or with nothing after it, everything is the title.
    """
    left = F.substring_index(headline, ":", 1)
    right = strip(F.regexp_replace(headline, r"(?s)\A[^:]*:", ""))
    cut = headline.contains(":") & (right != "")
    return F.when(cut, strip_or_null(left)), F.when(cut, right).otherwise(headline)


def read_weworkremotely(payloads: DataFrame) -> DataFrame:
    return entries_weworkremotely(payloads).filter(F.col("problem").isNull()).drop("problem")


def entries_weworkremotely(payloads: DataFrame) -> DataFrame:
    opened = _open_rss(payloads)
    kept = ["source", "company", "payload_id", "problem", *[c for c in (P.LANDED,) if c in opened.columns]]
    exploded = opened.select(*kept, F.posexplode_outer("records").alias("record_pos", "record"))
    rows = exploded.filter(F.col("record").isNotNull() | F.col("problem").isNotNull())

    def field(name: str) -> Column:
        texts = F.transform(F.col(f"record.{name}"), strip_or_null)
        return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))

    named = rows.select(*kept, "record_pos", "record", *[field(n).alias(f"_{n}") for n in _ITEM_FIELDS])
    company, title = split_headline(F.col("_title"))
    return _raw(
        named,
        url=F.col("_link"),
        external_id=F.col("_guid"),
        title=title,
        company=F.coalesce(F.col("_company"), company),
        description=F.col("_description"),
        location_text=F.col("_region"),
        contract_text=F.col("_type"),
        posted_at_text=F.col("_pubDate"),
        raw=F.to_json("record"),
    )


def problems_weworkremotely(payloads: DataFrame) -> DataFrame:
    return P.problems(_open_rss(payloads))


# --- Monthly thread ----------------------------------------------------------


def _hits(payloads: DataFrame, kind: str) -> DataFrame:
    chosen = payloads.filter((F.col("source") == "hackernews") & (F.col("kind") == kind))
    return P.open_json(chosen, "hits")


def latest_thread(payloads: DataFrame) -> DataFrame:
    """``story_id`` of the newest hiring thread; no row when there is none."""
    hits = P.records(_hits(payloads, "stories"))
    stories = hits.select(
        as_text(F.col("record"), "$.objectID").alias("story_id"),
        F.coalesce(F.try_variant_get("record", "$.title", "string"), F.lit("")).alias("title"),
        F.coalesce(F.try_variant_get("record", "$.created_at", "string"), F.lit("")).alias("created_at"),
    )
    threads = stories.filter(F.col("title").rlike(THREAD_TITLE) & F.col("story_id").isNotNull())
    newest = threads.agg(F.max_by("story_id", F.struct("created_at", "story_id")).alias("story_id"))
    return newest.filter(F.col("story_id").isNotNull())


def read_hackernews(payloads: DataFrame) -> DataFrame:
    """Top-level comments of the newest thread that are long enough to be ads."""
    return _comments(payloads, P.records(_hits(payloads, "comments")))


def entries_hackernews(payloads: DataFrame) -> DataFrame:
    """The comments, and what was unreadable, from one reading of their payloads;
    the few story payloads are read for the thread and for their problems."""
    hits = P.entries(_hits(payloads, "comments"))
    failed = hits.filter(F.col("problem").isNotNull()).select("source", F.col("company").alias("board"), "payload_id", "problem")
    of_stories = _thread_problems(payloads).withColumnRenamed("company", "board")
    return _comments(payloads, hits).unionByName(failed, allowMissingColumns=True).unionByName(of_stories, allowMissingColumns=True)


def _comments(payloads: DataFrame, hits: DataFrame) -> DataFrame:
    when = [c for c in ("problem", P.LANDED) if c in hits.columns]
    record = F.col("record")
    comments = hits.select(
        "source",
        "company",
        "payload_id",
        "record_pos",
        as_text(record, "$.parent_id").alias("story_id"),
        as_text(record, "$.objectID").alias("_id"),
        as_text(record, "$.comment_text").alias("_body"),
        as_text(record, "$.created_at").alias("_created"),
        F.to_json("record").alias("_raw"),
        *when,
    ).filter(F.col("_id").isNotNull() & (F.length("_body") >= MIN_POSTING_CHARS))
    # The thread is a single row by construction: an aggregate without groups.
    posted = comments.join(F.broadcast(latest_thread(payloads)), "story_id")
    titled = posted.withColumn("_title", first_line(html_to_text(F.col("_body")))).filter(F.col("_title").isNotNull())
    return _raw(
        titled,
        url=F.concat(F.lit(ITEM_URL), F.col("_id")),
        external_id=F.col("_id"),
        title=F.col("_title"),
        description=F.col("_body"),
        posted_at_text=F.col("_created"),
        raw=F.col("_raw"),
    )


def problems_hackernews(payloads: DataFrame) -> DataFrame:
    return P.problems(_hits(payloads, "comments")).unionByName(_thread_problems(payloads))


def _thread_problems(payloads: DataFrame) -> DataFrame:
    """Unreadable story payloads, and whether any names a thread."""
    unreadable = P.problems(_hits(payloads, "stories"))
    landed = payloads.filter((F.col("source") == "hackernews") & (F.col("kind") == "stories"))
    marks = landed.select(F.lit("landed").alias("mark")).unionByName(
        latest_thread(payloads).select(F.lit("thread").alias("mark"))
    )
    counted = marks.agg(*[F.count_if(F.col("mark") == m).alias(m) for m in ("landed", "thread")])
    missing = counted.filter((F.col("landed") > 0) & (F.col("thread") == 0)).select(
        F.lit("hackernews").alias("source"),
        F.lit(None).cast("string").alias("company"),
        F.lit(None).cast("string").alias("payload_id"),
        F.lit("no 'Who is hiring?' story found").alias("problem"),
    )
    return unreadable.unionByName(missing)
