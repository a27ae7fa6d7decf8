"""Checks over many listings: pay outside its market, vacancies that return."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import rates, reposts
from siftline.operators.normalise import unique_listings
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query

_FIGURES = "SELECT id, upper(pay_currency) AS currency, pay_period AS period, coalesce(contract_type, 'unknown') AS contract_type, CAST(pay_min AS DOUBLE) AS figure FROM {} WHERE pay_min > 0 AND pay_currency IS NOT NULL AND pay_period IS NOT NULL"
_BOUNDS = (
    "SELECT currency, period, contract_type, count(*) AS n, quantile_disc(figure, 0.25) AS q1, quantile_disc(figure, 0.5) AS median, quantile_disc(figure, 0.75) AS q3 "
    "FROM ({}) GROUP BY 1, 2, 3"
)


def _fenced(bounds: str, spread: float) -> str:
    return f"SELECT *, CASE WHEN n >= {rates.LEAST} THEN q1 / pow(q3 / q1, {spread}) END AS low, CASE WHEN n >= {rates.LEAST} THEN q3 * pow(q3 / q1, {spread}) END AS high FROM ({bounds})"


_BOTH = f"{_FIGURES.format('listings')} UNION ALL {_FIGURES.format('listings2')}"


@query("rate_bounds", O.with_(f"SELECT * REPLACE (round(low, 6) AS low, round(high, 6) AS high) FROM ({_fenced(_BOUNDS.format(_BOTH), rates.SPREAD)})", "listings", "listings2"))
def rate_bounds(spark, sf):
    """Sketches of two scrapes, merged."""
    scrapes = (L.listings(spark, sf), unique_listings(L.second_scrape(spark, sf), L.NOW))
    first, second = [rates.rate_sketches(s) for s in scrapes]
    bounds = rates.rate_bounds(rates.merge_sketches(first.unionByName(second)))
    return bounds.withColumns({c: F.round(c, 6) for c in ("low", "high")})


#: The derived pay is even; narrow bounds show which listings a fence picks.
_SPREAD = 0.25


@query(
    "implausible_rates",
    O.with_(
        "SELECT id, currency, period, contract_type, figure, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN figure < low THEN 'rate_low' ELSE 'rate_high' END AS problem "
        f"FROM ({_FIGURES.format('listings')}) JOIN ({_fenced(_BOUNDS.format(_FIGURES.format('listings')), _SPREAD)}) USING (currency, period, contract_type) WHERE figure < low OR figure > high",
        "listings",
    ),
)
def implausible_rates(spark, sf):
    rows = L.listings(spark, sf)
    flagged = rates.implausible_rates(rows, rates.rate_bounds(rates.rate_sketches(rows), spread=_SPREAD))
    return flagged.withColumns({c: F.round(c, 6) for c in ("low", "high")})


# Ten runs over the derived listings: each is seen in some of them, and gets a new
# id whenever it has been gone.
_RUNS = 10
_SEEN = "(doc_id * 7 + run * (1 + doc_id % 3)) % 5 < 3"
_NEW_ID = "concat(CAST(doc_id AS STRING), '-', CAST(CASE WHEN doc_id % 2 = 0 THEN run // 4 ELSE 0 END AS STRING))"
_SHAPE = r"nullif(trim(regexp_replace(regexp_replace(lower(title), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^\p{L}]+', ' ', 'g'), ' '), '')"


def sightings(spark, sf):
    runs = F.explode(F.sequence(F.lit(0), F.lit(_RUNS - 1))).alias("run")
    rows = L.raw_listings(spark, sf).select("doc_id", "company", "title", "source", runs).filter(_SEEN)
    return rows.withColumn("id", F.expr(_NEW_ID.replace("run // 4", "run div 4")))


@query(
    "repost_patterns",
    O.with_(
        """
SELECT company, shape, min(run)::INT AS first_run, max(run)::INT AS last_run, any_value(n_runs) AS n_runs, any_value(n_posts)::BIGINT AS n_posts, any_value(longest_gap)::BIGINT AS longest_gap,
  any_value(n_returned)::BIGINT AS n_returned_ids, count(DISTINCT id) AS n_ids, count(DISTINCT source) AS n_sources,
  CASE WHEN any_value(n_posts) > 1 AND any_value(n_returned) > 0 THEN CASE WHEN count(DISTINCT source) > 1 AND count(DISTINCT id) > 1 THEN 'reposted_and_spread' ELSE 'reposted' END ELSE 'spread' END AS pattern
FROM seen JOIN posts USING (company, shape) GROUP BY 1, 2
HAVING (any_value(n_posts) > 1 AND any_value(n_returned) > 0) OR (count(DISTINCT source) > 1 AND count(DISTINCT id) > 1)
""",
        "raw",
        seen=(
            f"SELECT lower(trim(company)) AS company, {_SHAPE} AS shape, {_NEW_ID} AS id, source, run FROM raw, range({_RUNS}) r(run) "
            f"WHERE {_SEEN} AND company <> '' AND {_SHAPE} IS NOT NULL"
        ),
        firsts="SELECT company, shape, id, min(run) AS first FROM seen GROUP BY ALL",
        present="SELECT DISTINCT company, shape, run FROM seen",
        gaps="SELECT *, coalesce(run - lag(run) OVER (PARTITION BY company, shape ORDER BY run) - 1, 0) AS missed FROM present",
        posts=(
            "SELECT company, shape, count(*) AS n_runs, 1 + count(*) FILTER (missed > 0) AS n_posts, max(missed) AS longest_gap, "
            "(SELECT count(*) FROM firsts f WHERE f.company = g.company AND f.shape = g.shape AND f.first >= (SELECT min(run) FROM gaps h WHERE h.company = g.company AND h.shape = g.shape AND h.missed > 0)) AS n_returned "
            "FROM gaps g GROUP BY company, shape"
        ),
    ),
)
def repost_patterns(spark, sf):
    return reposts.repost_patterns(sightings(spark, sf))
