"""Feed payloads derived from ``documents``, one table per feed.

Each document becomes a record of every feed, in the shape that feed publishes
and with its irregularities. Twenty documents make a payload, so a payload never
grows with the data. Some payloads are failed fetches or not what they should be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.listing_data import table
from siftline.plans.scratch import remove

PER_PAYLOAD = 20
BOARDS = 5
# Payload numbers (modulo 7) that fail: a fetch error, and a wrong document.
FETCH_FAILS, WRONG_SHAPE = 3, 5


def _text(c: Column) -> Column:
    """A JSON string token."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1)


def _object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object from ready-made tokens; a null token omits its field."""
    members = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _documents(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    """Of a folder of tables; or the documents themselves are given."""
    docs = (table(spark, tables, "documents") if isinstance(tables, str) else tables).select("doc_id", "text", "source")
    return docs.withColumnRenamed("source", "origin").withColumns({"d": F.col("doc_id").cast("string"), "chunk": _chunk()})


def _chunk() -> Column:
    return F.call_function("div", F.col("doc_id"), F.lit(PER_PAYLOAD)).cast("bigint")


def dealt(spark: SparkSession, sf_dir: str, folder: str, part_bytes: int, most_parts: int) -> Iterator[DataFrame]:
    """The documents in two parts or more, of about so many bytes of text each, or
    more bytes where there would be too many parts.

    A payload's documents are in one part. Parts are stored under ``folder``; each
    goes when the next is asked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, min(most_parts, -(-size // part_bytes)))
    numbered = docs.withColumn("part", F.pmod(F.hash(_chunk()), F.lit(parts)))
    # Every task writes to one part; a part has as many tasks as the session's shuffles allow.
    tasks = parts * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    numbered.repartitionById(tasks, F.pmod(F.hash(_chunk()), F.lit(tasks))).write.option("compression", "zstd").partitionBy("part").parquet(folder)
    for k in range(parts):
        yield spark.read.schema(numbered.schema).parquet(folder).filter(F.col("part") == k).drop("part")
        remove(spark, f"{folder}/part={k}")


def _payloads(records: DataFrame, source: str, head: str, tail: str, per_company: bool, kind: str = "listings", sep: str = ",") -> DataFrame:
    """Group ``(chunk, doc_id, record)`` into payload rows."""
    grouped = records.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("doc_id", "record"))).alias("r"))
    body = F.concat(F.lit(head), F.array_join(F.transform("r", lambda r: r["record"]), sep), F.lit(tail))
    state = F.col("chunk") % 7
    wrong = F.lit('{"oops": 1}') if kind == "listings" and source != "weworkremotely" else F.lit("<rss><channel>")
    faulty = per_company
    return grouped.select(
        F.lit(source).alias("source"),
        (F.concat(F.lit("board"), (F.col("chunk") % BOARDS).cast("string")) if per_company else F.lit(None).cast("string")).alias("company"),
        F.concat(F.lit(f"{source}-"), F.lpad(F.col("chunk").cast("string"), 12, "0")).alias("payload_id"),
        F.lit(kind).alias("kind"),
        (F.when(state == FETCH_FAILS, F.lit(None)).when(state == WRONG_SHAPE, wrong).otherwise(body) if faulty else body).alias("body"),
        (F.when(state == FETCH_FAILS, F.lit("HTTP 500")) if faulty else F.lit(None).cast("string")).alias("error"),
    )


def remoteok(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")
    record = _object(
        [
            ("id", F.when(d % 2 == 0, n).otherwise(F.concat(F.lit('"'), n, F.lit('"')))),
            ("url", F.when(d % 10 < 8, F.concat(F.lit('"https://feed.example.com/r/'), n, F.lit('"')))),
            ("apply_url", F.when(d % 10 == 8, F.concat(F.lit('" https://feed.example.com/apply/'), n, F.lit('"')))),
            ("position", F.when(d % 6 == 0, F.lit("null")).otherwise(_text(F.concat(F.lit("Engineer "), n)))),
            ("company", F.when(d % 4 == 0, F.lit("true")).otherwise(_text(F.col("origin")))),
            ("description", _text(F.col("text"))),
            ("salary", F.when(d % 3 == 0, F.lit("120000")).when(d % 3 == 1, F.lit('""')).otherwise(F.lit('"$90k - $120k"'))),
            ("date", F.lit('"2026-02-20T00:00:00+00:00"')),
            ("tags", F.when(d % 5 == 0, F.lit('"python"')).otherwise(F.lit('["python", 3, null, {"x": 1}, " sql "]'))),
        ]
    )
    notice = F.when(d % PER_PAYLOAD == 0, F.concat(F.lit('{"legal":"notice","url":"https://x"},"stray",'), record)).otherwise(record)
    return _payloads(_documents(spark, tables).select("chunk", "doc_id", notice.alias("record")), "remoteok", "[", "]", False)


def remotive(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")
    record = _object(
        [
            ("id", n),
            ("url", F.when(d % 10 != 9, F.concat(F.lit('"https://feed.example.org/j/'), n, F.lit('"')))),
            ("title", _text(F.concat(F.lit("Developer "), n))),
            ("company_name", _text(F.col("origin"))),
            ("candidate_required_location", F.when(d % 3 == 0, F.lit('"Worldwide"')).otherwise(F.lit('"  "'))),
            ("job_type", F.lit('"full_time"')),
            ("publication_date", F.lit('"2026-02-18T11:04:52"')),
            ("salary", F.lit('""')),
            ("tags", F.lit('["aws"]')),
            ("description", _text(F.col("text"))),
        ]
    )
    return _payloads(_documents(spark, tables).select("chunk", "doc_id", record.alias("record")), "remotive", '{"job-count":1,"jobs":[17,', "]}", False)


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def weworkremotely(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    headline = F.when(d % 4 == 0, F.concat(F.lit("Acme: Engineer: "), n)).when(d % 4 == 1, F.concat(F.lit("Developer "), n)).when(d % 4 == 2, F.concat(F.lit("Acme "), n, F.lit(":  "))).otherwise(F.concat(F.lit(": Role "), n))
    record = F.concat(
        F.lit("<item>"),
        tag("title", headline),
        F.when(d % 3 == 0, tag("region", F.lit("Anywhere in the World"))).otherwise(F.lit("")),
        tag("type", F.lit("Full-Time")),
        tag("description", _xml(F.concat(F.lit("<p>"), F.col("text")))),
        tag("pubDate", F.lit("Fri, 20 Feb 2026 07:30:48 +0000")),
        F.when(d % 10 == 7, F.lit("<link> </link>")).otherwise(tag("link", F.concat(F.lit("https://feed.example.net/w/"), n))),
        tag("link", F.lit("https://feed.example.net/second")),
        tag("guid", n),
        F.lit('<media:content url="https://x/l.png"/></item>'),
    )
    head = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Jobs</title>'
    records = _documents(spark, tables).select("chunk", "doc_id", record.alias("record"))
    return _payloads(records, "weworkremotely", head, "</channel></rss>", False, sep="")


def hackernews(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    """Every document is a story and a comment; most comments hang below the
    newest hiring thread."""
    d, n = F.col("doc_id"), F.col("d")
    docs = _documents(spark, tables)
    title = F.when(d % 3 == 0, F.lit('"Ask HN: Who is hiring? (2026)"')).when(d % 3 == 1, F.lit('"Ask HN: Who wants to be hired?"')).otherwise(F.lit("null"))
    stories = _object([("objectID", F.concat(F.lit('"9'), n, F.lit('"'))), ("title", title), ("created_at", F.concat(F.lit('"2026-02-01T'), F.lpad(n, 12, "0"), F.lit('"')))])
    newest = docs.filter(d % 3 == 0).agg(F.max("doc_id").cast("string"))
    joined = docs.withColumn("newest", newest.scalar())
    comments = _object(
        [
            ("objectID", F.when(d % 10 != 6, F.concat(F.lit('"'), n, F.lit('"')))),
            ("parent_id", F.concat(F.lit("9"), F.when(d % 4 == 0, n).otherwise(F.col("newest")))),
            ("created_at", F.lit('"2026-02-02T15:22:40.000Z"')),
            ("comment_text", F.when(d % 5 == 1, F.lit("null")).otherwise(_text(F.col("text")))),
        ]
    )
    first = _payloads(docs.select("chunk", "doc_id", stories.alias("record")), "hackernews", '{"hits":[', '],"page":0}', False, "stories")
    second = _payloads(joined.select("chunk", "doc_id", comments.alias("record")), "hackernews", '{"hits":["stray",', '],"page":0}', False, "comments")
    return first.unionByName(second)


def greenhouse(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")
    record = _object(
        [
            ("id", n),
            ("title", _text(F.concat(F.lit("Backend "), n))),
            ("updated_at", F.lit('"2026-02-17T12:31:04-04:00"')),
            ("absolute_url", F.when(d % 10 != 4, F.concat(F.lit('"https://boards.example.io/g/'), n, F.lit('"')))),
            ("location", F.when(d % 3 == 0, F.lit('"Remote"')).otherwise(F.lit('{"name":" Remote - EMEA "}'))),
            ("content", _text(F.concat(F.lit("&lt;p&gt;"), _xml(F.col("text")), F.lit(" &amp;amp; more&lt;/p&gt;")))),
        ]
    )
    return _payloads(_documents(spark, tables).select("chunk", "doc_id", record.alias("record")), "greenhouse", '{"jobs":[null,', '],"meta":{}}', True)


def lever(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")
    record = _object(
        [
            ("id", F.concat(F.lit('"l-'), n, F.lit('"'))),
            ("text", _text(F.concat(F.lit("Data "), n))),
            ("hostedUrl", F.when(d % 10 < 6, F.concat(F.lit('"https://jobs.example.co/l/'), n, F.lit('"')))),
            ("applyUrl", F.when(d % 10 < 9, F.concat(F.lit('"https://jobs.example.co/l/'), n, F.lit('/apply"')))),
            ("createdAt", F.when(d % 4 == 0, F.lit('"1757932800000"')).otherwise(F.concat((F.lit(1757932800000) + d * 1000).cast("string")))),
            ("categories", F.when(d % 5 == 0, F.lit('"none"')).otherwise(F.lit('{"commitment":"Contract","location":"Remote"}'))),
            ("salaryRange", F.lit('{"currency":"USD","min":1}')),
            ("description", _text(F.col("text"))),
        ]
    )
    return _payloads(_documents(spark, tables).select("chunk", "doc_id", record.alias("record")), "lever", "[", "]", True)


def ashby(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("d")
    record = _object(
        [
            ("id", F.concat(F.lit('"a-'), n, F.lit('"'))),
            ("title", F.when(d % 6 == 0, F.lit("null")).otherwise(_text(F.concat(F.lit("Staff "), n)))),
            ("employmentType", F.lit('"FullTime"')),
            ("location", F.lit('"Remote - Worldwide"')),
            ("publishedAt", F.lit('"2026-02-16T10:04:00.000Z"')),
            ("jobUrl", F.when(d % 10 != 2, F.concat(F.lit('"https://jobs.example.hq/a/'), n, F.lit('"')))),
            ("organizationName", F.when(d % 2 == 0, F.lit('"Example HQ"'))),
            ("descriptionHtml", _text(F.col("text"))),
            ("compensationTierSummary", F.when(d % 3 == 0, F.lit('"$170K – $200K"'))),
            ("compensation", F.when(d % 4 == 0, F.lit('"confidential"')).otherwise(F.lit('{"compensationTierSummary":"$85 per hour"}'))),
        ]
    )
    return _payloads(_documents(spark, tables).select("chunk", "doc_id", record.alias("record")), "ashby", '{"jobs":[[1, 2],', "]}", True)


FEEDS: dict[str, Callable[[SparkSession, str | DataFrame], DataFrame]] = {
    "remoteok": remoteok,
    "remotive": remotive,
    "weworkremotely": weworkremotely,
    "hackernews": hackernews,
    "greenhouse": greenhouse,
    "lever": lever,
    "ashby": ashby,
}


def all_payloads(spark: SparkSession, tables: str | DataFrame) -> DataFrame:
    parts = [build(spark, tables) for build in FEEDS.values()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
