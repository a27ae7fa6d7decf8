"""Listing queries, pages, search and statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from siftline.operators import order_index, ranking, reports, search_index, verification
from siftline.operators import views as V
from siftline.operators.normalise import normalise
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.plans.scratch import scratch_dir

_MATCH = "struct<score:int,reason:string,gaps:array<string>,provider:string,scored_at:timestamp>"


def served(spark, sf):
    """Curated listings as a finished run leaves them: every fifth is scored,
    every third verified."""
    scored = ranking.prescore(L.curated(spark, sf), L.PROFILE, L.NOW)
    d = F.col("doc_id")
    match = F.struct(
        (d % 101).cast("int").alias("score"), F.lit("r").alias("reason"), F.array(F.lit("g")).alias("gaps"),
        F.lit("p").alias("provider"), F.lit(None).cast("timestamp").alias("scored_at"),
    ).cast(_MATCH)
    checked = verification.assess_legitimacy(scored.drop("verification"), "_legit")
    return checked.withColumns(
        {
            "match": F.when(d % 5 == 0, match),
            "verification": F.when(d % 3 == 0, F.col("_legit")),
            "prescore": F.when(d % 7 != 0, F.col("prescore")),
        }
    ).drop("_legit")


_TIER = (
    "CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN weight >= 3 THEN 'scam' WHEN weight >= 2 THEN 'suspicious' ELSE 'ok' END) END"
)
_SERVED = (
    "SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN CAST(prescore AS DOUBLE) END AS prescore), "
    "CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 101 AS INTEGER) END AS score, "
    f"{_TIER} AS tier FROM (SELECT *, list_reduce(list_concat([0], list_transform({O.signal_rows('stext')}, lambda s: s.weight)), lambda a, b: a + b) AS weight FROM scored)"
)


def _sql(select: str) -> str:
    return O.with_(select, "scored", served=_SERVED)


_ORDER = {
    "match_score": "score DESC NULLS LAST, prescore DESC NULLS LAST, id",
    "prescore": "prescore DESC NULLS LAST, id",
    "posted_at": "posted_epoch DESC NULLS LAST, id",
    "last_seen": "id",
}

_FILTERS = {"statuses": ("new", "applied"), "eligibilities": ("eligible", "unknown"), "sources": tuple(f"src{i}" for i in range(12))}
_WHERE = f"status IN ('new', 'applied') AND effective IN ('eligible', 'unknown') AND source IN ({', '.join(O.q(s) for s in _FILTERS['sources'])})"


@query("list_jobs", _sql(f"SELECT id, title, source, status, effective FROM served WHERE {_WHERE}"))
def list_jobs(spark, sf):
    rows = V.list_jobs(served(spark, sf), **_FILTERS)
    return rows.select("id", "title", "source", "status", V.effective().alias("effective"))


@query("list_jobs_pending", _sql("SELECT id FROM served WHERE score IS NULL AND tier IS NULL"))
def list_jobs_pending(spark, sf):
    return V.list_jobs(served(spark, sf), unscored_only=True, unverified_only=True).select("id")


@query("list_jobs_tier", _sql("SELECT id, tier FROM served WHERE tier IN ('ok', 'suspicious')"))
def list_jobs_tier(spark, sf):
    return V.select_listings(served(spark, sf), tiers=("ok", "suspicious")).select("id", F.col("verification.tier").alias("tier"))


@query("list_jobs_score", _sql("SELECT id, score FROM served WHERE score BETWEEN 40 AND 80"))
def list_jobs_score(spark, sf):
    return V.select_listings(served(spark, sf), min_score=40, max_score=80).select("id", "match.score")


@query("list_jobs_date", _sql(f"SELECT id, posted_epoch FROM served WHERE posted_epoch >= {O.NOW_EPOCH - 30 * 86400} AND posted_epoch < {O.NOW_EPOCH - 2 * 86400}"))
def list_jobs_date(spark, sf):
    """Posted within the last thirty days, but not the last two."""
    rows = V.select_listings(served(spark, sf), posted_from=L.NOW - timedelta(days=30), posted_before=L.NOW - timedelta(days=2))
    return rows.select("id", F.unix_seconds("posted_at").alias("posted_epoch"))


@query("page_totals_filtered", _sql("SELECT count(*) AS total, count(*) FILTER (tier = 'ok' AND score >= 40) AS total_filtered FROM served"))
def page_totals_filtered(spark, sf):
    return V.page_totals(served(spark, sf), tiers=("ok",), min_score=40)


def _ordered(order: str) -> None:
    @query(f"order_{order}", _sql(f"SELECT id, row_number() OVER (ORDER BY {_ORDER[order]}) AS position FROM served"))
    def run(spark, sf):
        keyed = served(spark, sf).select("id", "match", "prescore", "posted_at", "last_seen_at")
        return V.ordered_positions(keyed, V.order_columns(order), scratch_dir(spark)).select("id", "position")


for _name in _ORDER:
    _ordered(_name)


@query("page", _sql(f"SELECT id, title FROM served ORDER BY {_ORDER['match_score']} LIMIT 50 OFFSET 100"))
def page(spark, sf):
    return V.list_jobs(served(spark, sf), limit=50, offset=100).select("id", "title")


@query("page_beyond_end", _sql("SELECT id FROM served WHERE false"))
def page_beyond_end(spark, sf):
    """An offset of as many rows as there are leaves nothing."""
    view = served(spark, sf)
    return V.list_jobs(view, limit=50, offset=L.listings(spark, sf).count()).select("id")


@query("page_after", _sql(f"SELECT id, prescore FROM served WHERE prescore < 0.5 OR prescore IS NULL OR (prescore = 0.5 AND id > '8') ORDER BY {_ORDER['prescore']} LIMIT 50"))
def page_after(spark, sf):
    return V.page_after(served(spark, sf), 0.5, "8", 50).select("id", "prescore")


def _indexed(order: str) -> None:
    at = f"SELECT id, row_number() OVER (ORDER BY {_ORDER[order]}) AS position FROM served"

    @query(
        f"order_index_{order}",
        _sql(f"SELECT 'offset' AS way, id, position FROM ({at}) WHERE position BETWEEN 101 AND 150 UNION ALL SELECT 'key', id, position FROM ({at}) WHERE position BETWEEN 151 AND 180"),
    )
    def run(spark, sf):
        """A page by offset, and the page after its last row by key."""
        path = scratch_dir(spark)
        order_index.build_order_index(served(spark, sf), order, path, files=16)
        first = order_index.page_at(spark, path, limit=50, offset=100)
        last = first.filter(F.col("position") == 150).first()
        found = first.select(F.lit("offset").alias("way"), "id", "position")
        if last is None:
            return found
        following = order_index.page_following(spark, path, tuple(last["key"]), limit=30)
        return found.unionByName(following.select(F.lit("key").alias("way"), "id", "position"))


for _name in _ORDER:
    _indexed(_name)


_SORTS = {
    "score": ("coalesce(score, prescore, -1)", True),
    "title": ("title", False),
    "company": ("coalesce(company, '')", True),
    "source": ("source", False),
    "posted_at": ("coalesce(posted_epoch, -4611686018427)", True),
}


def _sorted(column: str) -> None:
    key, descending = _SORTS[column]

    @query(f"column_sort_{column}", _sql(f"SELECT id, row_number() OVER (ORDER BY {key} {'DESC' if descending else 'ASC'}, id) AS position FROM served"))
    def run(spark, sf):
        keyed = served(spark, sf).select("id", "match", "prescore", "title", "company", "source", "posted_at")
        return V.ordered_positions(keyed, V.sort_columns(column, descending), scratch_dir(spark)).select("id", "position")


for _name in _SORTS:
    _sorted(_name)


@query("get_job", _sql("SELECT id, title, status, verdict FROM served WHERE id = (SELECT min(id) FROM served)"))
def get_job(spark, sf):
    """Looked up by exact id: the smallest one present."""
    view = served(spark, sf)
    smallest = L.listings(spark, sf).agg(F.min("id")).first()[0]
    return V.get_job(view, smallest).select("id", "title", "status", F.col("eligibility.eligibility").alias("verdict"))


_LIST = (
    "id, source, url, title, company, location_text, contract_type, pay_min AS compensation_minimum, pay_max AS compensation_maximum, "
    "pay_currency AS compensation_currency, pay_period AS compensation_period, effective AS eligibility, verdict AS eligibility_from_rules, "
    "eligibility_override, summary AS eligibility_summary, tier, score, prescore, status, notes"
)


def _flat(rows):
    return rows.withColumns({"tier": F.col("verification.tier"), "score": F.col("match.score")}).drop(
        "verification", "match", "tags", "posted_at", "first_seen_at", "last_seen_at"
    )


@query("list_view", _sql(f"SELECT {_LIST} FROM served"))
def list_view(spark, sf):
    return _flat(V.list_view(served(spark, sf)))


@query("detail_view", _sql(f"SELECT {_LIST}, md5(description) AS digest, 4 AS n_dimensions FROM served"))
def detail_view(spark, sf):
    rows = _flat(V.detail_view(served(spark, sf)))
    return rows.withColumns({"digest": F.md5("description"), "n_dimensions": F.size("dimensions")}).drop("description", "dimensions")


@query(
    "page_envelope",
    _sql(f"SELECT count(*) AS total, count(*) FILTER ({_WHERE}) AS total_filtered, CAST(50 AS INTEGER) AS \"limit\", CAST(0 AS INTEGER) AS \"offset\" FROM served"),
)
def page_envelope(spark, sf):
    return V.page_envelope(served(spark, sf), limit=50, offset=0, **_FILTERS)[1]


@query("page_envelope_items", _sql(f"SELECT {_LIST} FROM served WHERE {_WHERE} ORDER BY {_ORDER['match_score']} LIMIT 50 OFFSET 20"))
def page_envelope_items(spark, sf):
    return _flat(V.page_envelope(served(spark, sf), limit=50, offset=20, **_FILTERS)[0])


@query(
    "text_search",
    _sql("SELECT id, title FROM served WHERE contains(lower(concat_ws(' ', title, coalesce(company, ''), source, array_to_string(tags, ' '))), 'engineer company 1')"),
)
def text_search(spark, sf):
    return V.text_search(served(spark, sf), "  Engineer Company 1").select("id", "title")


@query(
    "text_search_indexed",
    _sql("SELECT id FROM served WHERE contains(lower(concat_ws(' ', title, coalesce(company, ''), source, array_to_string(tags, ' '))), 'engineer company 1')"),
)
def text_search_indexed(spark, sf):
    path = scratch_dir(spark)
    search_index.build_search_index(served(spark, sf), path)
    return search_index.search(spark, path, "  Engineer Company 1")


@query("count_jobs", O.with_("SELECT count(*) AS n FROM listings", "listings"))
def count_jobs(spark, sf):
    return V.count_jobs(L.listings(spark, sf))


@query("count_distinct", O.with_("SELECT count(*) AS fetched, count(DISTINCT id) AS \"unique\" FROM norm", "norm"))
def count_distinct(spark, sf):
    return reports.collect_counts(normalise(L.raw_listings(spark, sf), L.NOW))


@query("counts_by_eligibility", O.with_("SELECT effective AS eligibility, count(*) AS n FROM curated GROUP BY 1", "curated"))
def counts_by_eligibility(spark, sf):
    return V.counts_by_eligibility(L.curated(spark, sf))


@query(
    "stats",
    _sql(
        "SELECT 'total' AS facet, '' AS value, count(*) AS n FROM served UNION ALL SELECT 'eligibility', effective, count(*) FROM served GROUP BY 2 "
        "UNION ALL SELECT 'status', status, count(*) FROM served GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM served GROUP BY 2 "
        "UNION ALL SELECT 'scored', '', count(score) FROM served UNION ALL SELECT 'verified', '', count(tier) FROM served"
    ),
)
def stats(spark, sf):
    return reports.stats(served(spark, sf))


_RUNS = "SELECT CAST(epoch(ts) AS BIGINT) // 3600 AS run_id, event_type AS source, count(*) FILTER (value > 40) AS fetched FROM events GROUP BY 1, 2"


@query(
    "source_health",
    f"SELECT run_id, source, fetched, coalesce(fetched = 0 AND lag(fetched) OVER (PARTITION BY source ORDER BY run_id) = 0, false) AS broken FROM ({_RUNS})",
)
def source_health(spark, sf):
    """Hours as runs and event types as sources."""
    events = L.table(spark, sf, "events")
    hour = F.call_function("div", F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600)).cast("bigint")
    runs = events.groupBy(hour.alias("run_id"), F.col("event_type").alias("source")).agg(F.count_if(F.col("value") > 40).alias("fetched"))
    return reports.source_health(runs)
