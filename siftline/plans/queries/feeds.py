"""Feed readers over derived payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import coerce, text
from siftline.plans import feed_data as D
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.sources import feeds, payloads, registry

FIELDS = (
    "url", "external_id", "title", "company", "location_text", "compensation_text", "contract_text", "posted_at_text",
)


def _flat(rows):
    return rows.select(
        "source", *FIELDS, F.unix_seconds("posted_at").alias("posted_epoch"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"), F.md5("description").alias("digest"),
    )


def _expect(source: str, where: str, **columns: str) -> str:
    """Raw listings of one feed straight from the documents."""
    body = ", ".join(f"{columns.get(f, 'NULL')} AS {f}" for f in FIELDS)
    return (
        f"SELECT '{source}' AS source, {body}, CAST({columns.get('posted_epoch', 'NULL')} AS BIGINT) AS posted_epoch, "
        f"{columns.get('tags', chr(39) * 2)} AS tags, md5({columns.get('description', O.strip('text'))}) AS digest FROM d WHERE {where}"
    )


_D = "SELECT doc_id, text, source AS origin, CAST(doc_id AS VARCHAR) AS n, doc_id // 20 AS chunk FROM documents"
_READABLE = "chunk % 7 NOT IN (3, 5)"
_BOARD = "'board' || CAST(chunk % 5 AS VARCHAR)"
_BIG = "(SELECT max(doc_id) FROM d WHERE doc_id % 3 = 0)"
_BODY = "CASE doc_id % 5 WHEN 1 THEN NULL ELSE text END"
_FIRST = f"list_filter(list_transform(string_split({O.strip('text')}, chr(10)), lambda x: {O.strip('x')}), lambda x: x <> '')[1]"

EXPECTED = {
    "remoteok": _expect(
        "remoteok", "doc_id % 10 < 9",
        url="CASE WHEN doc_id % 10 < 8 THEN 'https://feed.example.com/r/' || n ELSE 'https://feed.example.com/apply/' || n END",
        external_id="n", title="CASE WHEN doc_id % 6 <> 0 THEN 'Engineer ' || n END",
        company="CASE WHEN doc_id % 4 <> 0 THEN origin END",
        compensation_text="CASE doc_id % 3 WHEN 0 THEN '120000' WHEN 2 THEN '$90k - $120k' END",
        posted_at_text="'2026-02-20T00:00:00+00:00'", tags="CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'python,3,sql' END",
    ),
    "remotive": _expect(
        "remotive", "doc_id % 10 <> 9", url="'https://feed.example.org/j/' || n", external_id="n", title="'Developer ' || n", company="origin",
        location_text="CASE WHEN doc_id % 3 = 0 THEN 'Worldwide' END", contract_text="'full_time'", posted_at_text="'2026-02-18T11:04:52'", tags="'aws'",
    ),
    "weworkremotely": _expect(
        "weworkremotely", "true",
        url="CASE WHEN doc_id % 10 = 7 THEN 'https://feed.example.net/second' ELSE 'https://feed.example.net/w/' || n END", external_id="n",
        title="CASE doc_id % 4 WHEN 0 THEN 'Engineer: ' || n WHEN 1 THEN 'Developer ' || n WHEN 2 THEN 'Acme ' || n || ':' ELSE 'Role ' || n END",
        company="CASE WHEN doc_id % 4 = 0 THEN 'Acme' END", location_text="CASE WHEN doc_id % 3 = 0 THEN 'Anywhere in the World' END",
        contract_text="'Full-Time'", posted_at_text="'Fri, 20 Feb 2026 07:30:48 +0000'", description=O.strip("'<p>' || text"),
    ),
    "hackernews": _expect(
        "hackernews", f"doc_id % 10 <> 6 AND doc_id % 4 <> 0 AND length({O.strip(_BODY)}) >= 100",
        url="'https://news.ycombinator.com/item?id=' || n", external_id="n", title=_FIRST, posted_at_text="'2026-02-02T15:22:40.000Z'",
    ),
    "greenhouse": _expect(
        "greenhouse", f"doc_id % 10 <> 4 AND {_READABLE}", url="'https://boards.example.io/g/' || n", external_id="n", title="'Backend ' || n",
        company=_BOARD, location_text="CASE WHEN doc_id % 3 <> 0 THEN 'Remote - EMEA' END", posted_at_text="'2026-02-17T12:31:04-04:00'",
        description="'<p>' || text || ' &amp; more</p>'",
    ),
    "lever": _expect(
        "lever", f"doc_id % 10 < 9 AND {_READABLE}",
        url="'https://jobs.example.co/l/' || n || CASE WHEN doc_id % 10 < 6 THEN '' ELSE '/apply' END", external_id="'l-' || n", title="'Data ' || n",
        company=_BOARD, location_text="CASE WHEN doc_id % 5 <> 0 THEN 'Remote' END", contract_text="CASE WHEN doc_id % 5 <> 0 THEN 'Contract' END",
        posted_epoch="CASE WHEN doc_id % 4 <> 0 THEN 1757932800 + doc_id END",
    ),
    "ashby": _expect(
        "ashby", f"doc_id % 10 <> 2 AND {_READABLE}", url="'https://jobs.example.hq/a/' || n", external_id="'a-' || n",
        title="CASE WHEN doc_id % 6 <> 0 THEN 'Staff ' || n END", company=f"CASE WHEN doc_id % 2 = 0 THEN 'Example HQ' ELSE {_BOARD} END",
        location_text="'Remote - Worldwide'", contract_text="'FullTime'", posted_at_text="'2026-02-16T10:04:00.000Z'",
        compensation_text="CASE WHEN doc_id % 3 = 0 THEN '$170K – $200K' WHEN doc_id % 4 <> 0 THEN '$85 per hour' END",
    ),
}
READERS = {name: feed.read for name, feed in registry.REGISTRY.items()}


def _reader(name: str) -> None:
    @query(f"read_{name}", O.with_(EXPECTED[name], d=_D))
    def run(spark, sf):
        return _flat(READERS[name](D.FEEDS[name](spark, sf)))


for _name in EXPECTED:
    _reader(_name)


@query("split_headline", O.with_("SELECT doc_id, CASE WHEN strpos(h, ':') > 0 AND trim(substr(h, strpos(h, ':') + 1)) <> '' THEN nullif(trim(split_part(h, ':', 1)), '') END AS company, CASE WHEN strpos(h, ':') > 0 AND trim(substr(h, strpos(h, ':') + 1)) <> '' THEN trim(substr(h, strpos(h, ':') + 1)) ELSE h END AS title FROM h", h="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ': ' || text WHEN 1 THEN source ELSE source || ':  ' END AS h FROM (SELECT doc_id, source, replace(text, chr(10), ' ') AS text FROM documents)"))
def split_headline(spark, sf):
    body = F.replace("text", F.lit("\n"), F.lit(" "))
    d = F.col("doc_id") % 4
    headline = F.when(d == 0, F.concat("source", F.lit(": "), body)).when(d == 1, F.col("source")).otherwise(F.concat("source", F.lit(":  ")))
    company, title = feeds.split_headline(headline)
    return L.table(spark, sf, "documents").select("doc_id", company.alias("company"), title.alias("title"))


@query("latest_thread", O.with_(f"SELECT '9' || CAST({_BIG} AS VARCHAR) AS story_id", d=_D))
def latest_thread(spark, sf):
    return feeds.latest_thread(D.hackernews(spark, sf))


@query("first_line_title", O.with_(f"SELECT doc_id, {_FIRST} AS title FROM d", d=_D))
def first_line_title(spark, sf):
    return L.table(spark, sf, "documents").select("doc_id", text.first_line(text.html_to_text(F.col("text"))).alias("title"))


_K = "CAST(regexp_extract(props, '-?[0-9]+', 0) AS BIGINT)"


@query(
    "coerce_text",
    f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST({_K} AS VARCHAR) WHEN 1 THEN nullif(event_type, 'view') END AS value FROM events",
)
def coerce_text(spark, sf):
    """Numbers and text stay; blank text, booleans, nulls and objects go."""
    events = L.table(spark, sf, "events")
    n = F.col("event_id") % 5
    k = F.get_json_object("props", "$.k")
    word = F.when(F.col("event_type") == "view", F.lit('"  "')).otherwise(F.concat(F.lit('" '), F.col("event_type"), F.lit('"')))
    token = F.when(n == 0, k).when(n == 1, word).when(n == 2, F.lit("true")).when(n == 3, F.lit("null")).otherwise(F.col("props"))
    record = F.parse_json(F.concat(F.lit('{"v":'), token, F.lit("}")))
    return events.select("event_id", coerce.as_text(record, "$.v").alias("value"))


@query(
    "coerce_tags",
    f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ',' || CAST({_K} AS VARCHAR) END AS tags FROM events",
)
def coerce_tags(spark, sf):
    events = L.table(spark, sf, "events")
    items = F.concat(F.lit('[" '), F.col("event_type"), F.lit('", null, true, '), F.get_json_object("props", "$.k"), F.lit(', {"x":1}, ""]'))
    token = F.when(F.col("event_id") % 4 == 0, F.lit('"python"')).otherwise(items)
    record = F.parse_json(F.concat(F.lit('{"v":'), token, F.lit("}")))
    return events.select("event_id", F.array_join(coerce.as_tags(record, "$.v"), ",").alias("tags"))


_ALL = ("remoteok", "remotive", "weworkremotely", "hackernews", "greenhouse", "lever", "ashby")
_COMPANIES = {name: [f"board{i}" for i in range(D.BOARDS)] for name in ("greenhouse", "lever", "ashby")}


def _sources():
    return registry.build_sources(_ALL, _COMPANIES)


_COUNTED = " UNION ALL ".join(f"SELECT source, url FROM ({EXPECTED[n]})" for n in _ALL)


@query("require_url", O.with_(f"SELECT source, count(*) AS n, count(DISTINCT url) AS urls FROM ({_COUNTED}) GROUP BY source", d=_D))
def require_url(spark, sf):
    """Records with a URL per feed; those without are gone."""
    rows = registry.union_sources(D.all_payloads(spark, sf), _sources())
    return rows.groupBy("source").agg(F.count("url").alias("n"), F.count_distinct("url").alias("urls"))


@query("union_sources", O.with_(" UNION ALL ".join(f"SELECT {i} AS source_priority, * FROM ({EXPECTED[n]})" for i, n in enumerate(_ALL)), d=_D))
def union_sources(spark, sf):
    rows = registry.union_sources(D.all_payloads(spark, sf), _sources())
    return _flat(rows).join(registry.configured(spark, _sources()), "source")


@query(
    "ats_fanout",
    O.with_(
        "SELECT source, company, problem, count(*) AS n FROM (SELECT DISTINCT chunk, "
        f"{_BOARD} AS company, CASE WHEN chunk % 7 = 3 THEN 'HTTP 500' ELSE p END AS problem, source FROM d, "
        "(SELECT 'greenhouse' AS source, 'response has no ''jobs'' array' AS p UNION ALL SELECT 'lever', 'expected a JSON array' UNION ALL SELECT 'ashby', 'response has no ''jobs'' array') "
        "WHERE chunk % 7 IN (3, 5)) GROUP BY ALL",
        d=_D,
    ),
)
def ats_fanout(spark, sf):
    """Failed boards, each on its own; the others' rows are unharmed."""
    chosen = registry.build_sources(("greenhouse", "lever", "ashby"), _COMPANIES)
    problems = registry.source_problems(D.all_payloads(spark, sf), chosen)
    return problems.groupBy("source", "company", "problem").agg(F.count("*").alias("n"))


@query(
    "source_outcomes",
    O.with_(
        "SELECT source, CAST(count(*) AS BIGINT) AS fetched, CASE WHEN source IN ('greenhouse', 'ashby') "
        "THEN (SELECT count(DISTINCT chunk) FROM d WHERE chunk % 7 IN (3, 5)) ELSE 0 END AS failed_payloads, CAST(NULL AS VARCHAR) AS error, 'ok' AS state "
        f"FROM ({_COUNTED}) WHERE source NOT IN ('lever', 'remotive', 'weworkremotely') GROUP BY source "
        "UNION ALL SELECT 'lever', 0, count(DISTINCT chunk), 'all ' || CAST(count(DISTINCT chunk) AS VARCHAR) || ' configured boards failed: timed out', 'error' FROM d "
        "UNION ALL SELECT 'weworkremotely', count(*) FILTER (chunk % 7 <> 3), count(DISTINCT chunk) FILTER (chunk % 7 = 3), NULL, 'ok' FROM d "
        "UNION ALL SELECT 'remotive', 0, 0, NULL, 'empty'",
        d=_D,
    ),
)
def source_outcomes(spark, sf):
    """One feed whose boards all failed, one that gave nothing, one without boards
    that lost some payloads, four that work."""
    from siftline.operators.reports import source_outcomes as outcomes

    landed = D.all_payloads(spark, sf)
    lost = F.col("source") == "lever"
    empty = F.col("source") == "remotive"
    some = (F.col("source") == "weworkremotely") & (F.substring("payload_id", -12, 12).cast("bigint") % 7 == 3)
    landed = landed.withColumns(
        {
            "body": F.when(empty, F.lit('{"jobs":[]}')).when(~lost & ~some, F.col("body")),
            "error": F.when(lost, F.lit("timed out")).when(some, F.lit("HTTP 500")).otherwise(F.col("error")),
        }
    )
    sources = _sources()
    fetched = registry.union_sources(landed, sources).select("source")
    errors = registry.source_errors(registry.source_problems(landed, sources), fetched)
    return outcomes(registry.configured(spark, sources), fetched, errors).select("source", "fetched", "failed_payloads", "error", "state")


@query(
    "raw_payloads",
    O.with_(
        "SELECT 'remotive' AS source, n AS external_id, md5(text) AS digest FROM d WHERE doc_id % 10 <> 9 "
        f"UNION ALL SELECT 'lever', 'l-' || n, md5(text) FROM d WHERE doc_id % 10 < 9 AND {_READABLE}",
        d=_D,
    ),
)
def raw_payloads(spark, sf):
    """The records of two feeds as they arrived, from a run's stored record table."""
    from siftline.plans.curation import Store, store_records
    from siftline.plans.scratch import scratch_dir

    chosen = registry.build_sources(("remotive", "lever"), _COMPANIES)
    landed = D.FEEDS["remotive"](spark, sf).unionByName(D.FEEDS["lever"](spark, sf))
    records = store_records(Store(spark, scratch_dir(spark)), 1, landed, chosen)
    return records.select("source", "external_id", F.md5(F.get_json_object("raw", "$.description")).alias("digest"))


@query(
    "raw_at_paths",
    O.with_(
        "SELECT 'remotive' AS source, n AS external_id, md5(text) AS digest FROM d WHERE doc_id % 10 <> 9 "
        f"UNION ALL SELECT 'lever', 'l-' || n, md5(text) FROM d WHERE doc_id % 10 < 9 AND {_READABLE}",
        d=_D,
    ),
)
def raw_at_paths(spark, sf):
    """The same records retained as VARIANT; both columns are read by path."""
    from siftline.plans.scratch import scratch_dir
    from siftline.sources import raw_store

    chosen = registry.build_sources(("remotive", "lever"), _COMPANIES)
    landed = D.FEEDS["remotive"](spark, sf).unionByName(D.FEEDS["lever"](spark, sf))
    records, path = registry.union_sources(landed, chosen).select("source", "raw"), scratch_dir(spark)
    raw_store.retain(records, path)
    kept = raw_store.read_retained(spark, path, records.schema)
    return kept.select("source", raw_store.at("$.id").alias("external_id"), F.md5(raw_store.at("$.description")).alias("digest"))


@query(
    "source_registry",
    O.with_(
        f"SELECT source, count(*) AS n FROM ({_COUNTED}) WHERE source IN ('remotive', 'remoteok') GROUP BY source "
        f"UNION ALL SELECT source, count(*) FROM ({EXPECTED['lever']}) WHERE company = 'board1' GROUP BY source",
        d=_D,
    ),
)
def source_registry(spark, sf):
    """Chosen feeds and configured boards only; a per-company feed without companies
    is left out."""
    chosen = registry.build_sources(("remotive", "greenhouse", "lever", "remoteok"), {"lever": ["board1"], "greenhouse": [" "]})
    rows = registry.union_sources(D.all_payloads(spark, sf), chosen)
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("payload_problems", O.with_("SELECT 'lever-' || lpad(CAST(chunk AS VARCHAR), 12, '0') AS payload_id, CASE chunk % 7 WHEN 3 THEN 'HTTP 500' ELSE 'expected a JSON array' END AS problem FROM (SELECT DISTINCT chunk FROM d) WHERE chunk % 7 IN (3, 5)", d=_D))
def payload_problems(spark, sf):
    """Quarantined payloads of one feed."""
    return payloads.problems(payloads.open_json(D.lever(spark, sf), None)).select("payload_id", "problem")


_FILES = tuple(n for n in _ALL if n != "hackernews")
#: Text of the documents whose responses land at once, and how many such parts at most.
#: On disk a part's responses and what is made of them on the way to the store come to
#: some nine bytes a byte of text, the stored listings to two.
PART_BYTES, MOST_PARTS = 24 << 20, 24


@query(
    "landing_stream",
    O.with_(
        " UNION ALL ".join(
            f"SELECT '{n}' AS source, count(DISTINCT {O.canonical('url')}) AS n FROM ({EXPECTED[n]}) WHERE trim(coalesce(title, '')) <> ''" for n in _FILES
        ),
        d=_D,
    ),
)
def landing_stream(spark, sf):
    """Six feeds' responses as files, one each, taken by a stream in two batches or
    more; listings per feed. A file has no name of its own here, so the thread
    feed, whose files are told apart by name, is left to its own query.

    Part after part of the responses lands and is taken; what the store has then
    taken leaves the landing, so that the disk holds the listings and one part."""
    from siftline.plans.scratch import free_shuffles, remove, scratch_dir
    from siftline.streaming.ingest import ingest_landing
    from siftline.streaming.merge_store import MergeStore

    root = scratch_dir(spark)
    store, sources = MergeStore(spark, f"{root}/store", buckets=8), registry.build_sources(_FILES, _COMPANIES)
    for part in D.dealt(spark, sf, f"{root}/documents", PART_BYTES, MOST_PARTS):
        free_shuffles(spark)
        payloads.land(D.all_payloads(spark, part).filter(F.col("source").isin(*_FILES)), f"{root}/landing")
        ingest_landing(spark, f"{root}/landing", store, sources, L.NOW, keep=False)
        remove(spark, f"{root}/landing")
    return store.current().groupBy("source").agg(F.count("*").alias("n"))
