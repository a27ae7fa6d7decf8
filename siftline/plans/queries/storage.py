"""Change detection, snapshots, user-owned state, sinks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from siftline.operators import snapshots as S
from siftline.operators import verification
from siftline.operators.normalise import unique_listings
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.plans.scratch import scratch_dir
from siftline.sources import sinks
from siftline.streaming import ingest as stream
from siftline.streaming.merge_store import MergeStore

LATER = L.NOW + timedelta(days=7)


def _second(spark, sf):
    return unique_listings(L.second_scrape(spark, sf), LATER)


_CHANGE = (
    "SELECT n.id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN o.content_hash <> n.content_hash THEN 'updated' ELSE 'unchanged' END AS change "
    "FROM listings2 n LEFT JOIN listings o USING (id)"
)


@query("classify_change", O.with_(_CHANGE, "listings", "listings2"))
def classify_change(spark, sf):
    return S.classify_change(_second(spark, sf), L.listings(spark, sf))


@query(
    "upsert_report",
    O.with_(
        "SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated, "
        f"count(*) FILTER (change = 'unchanged') AS unchanged, count(*) AS total FROM ({_CHANGE})",
        "listings",
        "listings2",
    ),
)
def upsert_report(spark, sf):
    return S.upsert_report(S.classify_change(_second(spark, sf), L.listings(spark, sf)))


def _seen(df):
    return df.select(
        "id", "source", "url", "external_id", "title", "content_hash",
        F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"),
    )


_LATER = O.NOW_EPOCH + 7 * 86400
_UPSERT = (
    "SELECT coalesce(o.id, n.id) AS id, coalesce(o.source, n.source) AS source, coalesce(o.url, n.url) AS url, "
    "coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.title, o.title) AS title, coalesce(n.content_hash, o.content_hash) AS content_hash, "
    f"CAST(CASE WHEN o.id IS NULL THEN {_LATER} ELSE {O.NOW_EPOCH} END AS BIGINT) AS first_seen, "
    f"CAST(CASE WHEN n.id IS NULL THEN {O.NOW_EPOCH} ELSE {_LATER} END AS BIGINT) AS last_seen "
    "FROM listings o FULL OUTER JOIN listings2 n ON o.id = n.id"
)


@query("upsert_snapshot", O.with_(_UPSERT, "listings", "listings2"))
def upsert_snapshot(spark, sf):
    """The first scrape, then a later one with changes and removals."""
    return _seen(S.upsert_snapshot(L.listings(spark, sf), _second(spark, sf)))


@query("upsert_idempotent", O.with_(_UPSERT, "listings", "listings2"))
def upsert_idempotent(spark, sf):
    """Applying the same scrape twice equals applying it once."""
    once = S.upsert_snapshot(L.listings(spark, sf), _second(spark, sf))
    return _seen(S.upsert_snapshot(once, _second(spark, sf)))


@query("known_content_hashes", O.with_("SELECT DISTINCT content_hash FROM listings", "listings"))
def known_content_hashes(spark, sf):
    return S.known_content_hashes(L.listings(spark, sf))


@query("save_prescore", "SELECT user_id AS id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def save_prescore(spark, sf):
    """Every event is a write of its user's value; the last one stands."""
    writes = L.table(spark, sf, "events").select(F.col("user_id").alias("id"), "value", F.col("event_id").alias("seq"))
    return S.latest_by_key(writes, "value")


@query(
    "save_match",
    "SELECT user_id AS id, max_by(CAST(floor(value) AS BIGINT) % 101, event_id) AS score, max_by(event_type, event_id) AS reason FROM events GROUP BY user_id",
)
def save_match(spark, sf):
    """A nested value is written and replaced as a whole."""
    match = F.struct((F.floor("value") % 101).cast("bigint").alias("score"), F.col("event_type").alias("reason")).alias("match")
    writes = L.table(spark, sf, "events").select(F.col("user_id").alias("id"), match, F.col("event_id").alias("seq"))
    return S.latest_by_key(writes, "match").select("id", "match.score", "match.reason")


@query("save_eligibility", O.with_("SELECT id, CASE WHEN doc_id % 4 = 1 THEN 'unknown' ELSE verdict END AS verdict FROM curated", "curated"))
def save_eligibility(spark, sf):
    """Two runs store verdicts; the second, over a quarter of the listings, stands there."""
    first = L.curated(spark, sf).select("id", "doc_id", "eligibility", F.lit(1).alias("seq"))
    again = F.col("eligibility").withField("eligibility", F.lit("unknown"))
    second = first.filter("doc_id % 4 = 1").withColumns({"eligibility": again, "seq": F.lit(2)})
    return S.latest_by_key(second.unionByName(first), "eligibility").select("id", F.col("eligibility.eligibility").alias("verdict"))


@query("save_verification", O.with_("SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'expired' ELSE 'ok' END AS tier, CASE WHEN doc_id % 3 = 0 THEN 'Listing page returns HTTP 404' ELSE '' END AS reasons FROM listings", "listings"))
def save_verification(spark, sf):
    """Every listing was reachable at first; a third of the pages is gone later."""
    seen = L.listings(spark, sf, keep=("doc_id",)).select("id", "doc_id")

    def fetched(rows, status: int, seq: int):
        page = {"http_status": F.lit(status), "content_type": F.lit("text/html"), "body": F.lit(""), "error": F.lit(None).cast("string")}
        return verification.classify_liveness(rows.withColumns(page), "verification").select("id", "verification", F.lit(seq).alias("seq"))

    writes = fetched(seen, 200, 1).unionByName(fetched(seen.filter("doc_id % 3 = 0"), 404, 2))
    return S.latest_by_key(writes, "verification").select("id", "verification.tier", F.array_join("verification.reasons", "; ").alias("reasons"))


_FIELD = "CASE event_type WHEN 'click' THEN 'status' WHEN 'purchase' THEN 'notes' WHEN 'signup' THEN 'eligibility_override' END"
_VALUE = (
    "CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'shortlisted' WHEN 1 THEN 'applied' ELSE 'dismissed' END "
    "WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('note ', CAST(event_id AS STRING)) END "
    "WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' END END"
)


def user_events(spark, sf):
    """The event stream read as edits of user-owned fields."""
    return L.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.expr(_FIELD).alias("field"), F.expr(_VALUE).alias("value"), F.col("event_id").alias("seq")
    ).filter(F.col("field").isNotNull())


def _last(field: str) -> str:
    return f"arg_max_null(value, seq) FILTER (field = '{field}')"


@query(
    "set_user_fields",
    f"SELECT id, coalesce({_last('status')}, 'new') AS status, {_last('notes')} AS notes, {_last('eligibility_override')} AS eligibility_override "
    f"FROM (SELECT CAST(user_id AS VARCHAR) AS id, {_FIELD} AS field, {_VALUE} AS value, event_id AS seq FROM events) WHERE field IS NOT NULL GROUP BY id",
)
def set_user_fields(spark, sf):
    return S.user_state(user_events(spark, sf))


def _single(field: str) -> None:
    fallback = "'new'" if field == "status" else "NULL"

    @query(
        f"set_{field}",
        f"SELECT id, coalesce({_last(field)}, {fallback}) AS value "
        f"FROM (SELECT CAST(user_id AS VARCHAR) AS id, {_FIELD} AS field, {_VALUE} AS value, event_id AS seq FROM events) WHERE field = '{field}' GROUP BY id",
    )
    def run(spark, sf):
        writes = user_events(spark, sf).filter(F.col("field") == field)
        events = S.user_event(writes, field, F.col("value"), F.col("seq"))
        return S.user_state(events).select("id", F.col(field).alias("value"))


_single("status")
_single("notes")
_single("eligibility_override")

_BODY = (
    "CASE event_id % 8 WHEN 0 THEN '{\"status\":\"applied\"}' WHEN 1 THEN '{\"notes\":\"call back\"}' WHEN 2 THEN '{\"notes\":\"\"}' "
    "WHEN 3 THEN '{\"eligibility_override\":\"clear\"}' WHEN 4 THEN '{\"statsu\":\"applied\"}' WHEN 5 THEN '{\"status\":\"hired\"}' "
    "WHEN 6 THEN '{\"eligibility_override\":\"eligible\",\"status\":null}' ELSE 'not json' END"
)


def _checked(spark, sf):
    patches = L.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.expr(_BODY).alias("body"), F.col("event_id").alias("seq")
    )
    known = L.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    return S.check_patches(patches, known)


_PROBLEM = (
    "CASE event_id % 8 WHEN 7 THEN 'unreadable' WHEN 4 THEN 'unknown field' WHEN 5 THEN 'bad status' "
    "ELSE CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'unknown id' END END"
)


@query(
    "patch_job",
    "SELECT CAST(user_id AS VARCHAR) AS id, CASE event_id % 8 WHEN 0 THEN 'status' WHEN 1 THEN 'notes' WHEN 2 THEN 'notes' ELSE 'eligibility_override' END AS field, "
    "CASE event_id % 8 WHEN 0 THEN 'applied' WHEN 1 THEN 'call back' WHEN 6 THEN 'eligible' END AS value, event_id AS seq "
    f"FROM events WHERE ({_PROBLEM}) IS NULL",
)
def patch_job(spark, sf):
    return S.patch_events(_checked(spark, sf))


@query("patch_rejects", f"SELECT event_id AS seq, {_PROBLEM} AS problem FROM events WHERE ({_PROBLEM}) IS NOT NULL")
def patch_rejects(spark, sf):
    return _checked(spark, sf).filter(F.col("problem").isNotNull()).select("seq", "problem")


# --- sinks: written, then read back ---


@query("sink_snapshot", O.with_("SELECT id, source, title, content_hash FROM listings", "listings"))
def sink_snapshot(spark, sf):
    path = scratch_dir(spark)
    sinks.sink_snapshot(L.listings(spark, sf), path)
    return spark.read.parquet(path).select("id", "source", "title", "content_hash")


@query(
    "sink_csv_export",
    O.with_("SELECT id, title, company, array_to_string(tags, ',') AS tags, effective AS eligibility, summary AS eligibility_summary, status, notes FROM curated", "curated"),
)
def sink_csv_export(spark, sf):
    path = scratch_dir(spark)
    sinks.sink_csv_export(L.curated(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("id", "title", "company", F.coalesce("tags", F.lit("")).alias("tags"), "eligibility", "eligibility_summary", "status", "notes")


@query("incremental_ingest", O.with_(_UPSERT, "listings", "listings2"))
def incremental_ingest(spark, sf):
    """Two landed scrapes, picked up by two runs of the same stream."""
    root = scratch_dir(spark)
    landing, store = f"{root}/landing", f"{root}/store"
    first, second = L.raw_listings(spark, sf), L.second_scrape(spark, sf)
    first.write.mode("append").parquet(landing)
    stream.ingest_available(spark, landing, first.schema, store, L.NOW)
    second.select(*first.columns).write.mode("append").parquet(landing)
    stream.ingest_available(spark, landing, first.schema, store, LATER)
    return _seen(stream.current_listings(spark, store))


@query("merge_store", O.with_(_UPSERT, "listings", "listings2"))
def merge_store(spark, sf):
    """Two scrapes as generations, compacted, the second one delivered twice."""
    store = MergeStore(spark, scratch_dir(spark), buckets=8)
    store.upsert(L.listings(spark, sf), "scrapes", 0)
    for _ in range(2):
        store.upsert(_second(spark, sf), "scrapes", 1)
    store.compact(most_files=1)
    store.vacuum()
    return _seen(store.current())
