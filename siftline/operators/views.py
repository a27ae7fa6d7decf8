"""Reading the curated listings: filters, orders, pages and projections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.dates import timestamp_literal
from siftline.operators.eligibility import effective_eligibility, summary

MAX_PAGE = 500
ORDERS = ("match_score", "prescore", "posted_at", "last_seen")
SORTS = ("score", "title", "company", "source", "posted_at")


def effective() -> Column:
    return effective_eligibility(F.col("eligibility_override"), F.col("eligibility"))


def order_columns(order_by: str) -> list[Column]:
    """A total order; an unknown name means the default. Ids break ties."""
    score, pre = F.col("match.score").desc_nulls_last(), F.col("prescore").desc_nulls_last()
    orders = {
        "match_score": [score, pre],
        "prescore": [pre],
        "posted_at": [F.col("posted_at").desc_nulls_last()],
        "last_seen": [F.col("last_seen_at").desc()],
    }
    return [*orders.get(order_by, orders["match_score"]), F.col("id").asc()]


def sort_columns(column: str, descending: bool = False) -> list[Column]:
    """The order of a table header; a missing score counts as -1."""
    keys = {
        "score": F.coalesce(F.col("match.score").cast("double"), F.col("prescore"), F.lit(-1.0)),
        "title": F.col("title"),
        "company": F.coalesce("company", F.lit("")),
        "source": F.col("source"),
        "posted_at": F.coalesce(F.unix_micros("posted_at"), F.lit(-(2**62))),
    }
    key = keys[column]
    return [key.desc() if descending else key.asc(), F.col("id").asc()]


def column_sort(view: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort as the table headers do."""
    return view.orderBy(*sort_columns(column, descending))


def conditions(
    *,
    unscored_only: bool = False,
    unverified_only: bool = False,
    statuses: Sequence[str] = (),
    eligibilities: Sequence[str] = (),
    sources: Sequence[str] = (),
    tiers: Sequence[str] = (),
    min_score: int | None = None,
    max_score: int | None = None,
    posted_from: datetime | None = None,
    posted_before: datetime | None = None,
) -> list[Column]:
    """All must hold; several values of one are alternatives.

    A listing without a tier, score or date fails every condition on it.
    """
    result = []
    if tiers:
        result.append(F.col("verification.tier").isin(*tiers))
    if min_score is not None:
        result.append(F.col("match.score") >= min_score)
    if max_score is not None:
        result.append(F.col("match.score") <= max_score)
    if posted_from is not None:
        result.append(F.col("posted_at") >= timestamp_literal(posted_from))
    if posted_before is not None:
        result.append(F.col("posted_at") < timestamp_literal(posted_before))
    if sources:
        result.append(F.col("source").isin(*sources))
    if unscored_only:
        result.append(F.col("match").isNull())
    if unverified_only:
        result.append(F.col("verification").isNull())
    if statuses:
        result.append(F.col("status").isin(*statuses))
    if eligibilities:
        result.append(effective().isin(*eligibilities))
    return result


def select_listings(view: DataFrame, **filters) -> DataFrame:
    result = view
    for condition in conditions(**filters):
        result = result.filter(condition)
    return result


def list_jobs(view: DataFrame, *, order_by: str = "match_score", limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """The listing query. With a limit Spark keeps only the top rows per task."""
    ordered = select_listings(view, **filters).orderBy(*order_columns(order_by))
    return ordered if limit is None else page(ordered, limit, offset)


def ordered_positions(keyed: DataFrame, order: Sequence[Column], path: str) -> DataFrame:
    """Every row with its 1-based ``position`` in the given total order.

    The rows are stored under ``path`` first, as dealing out by range reads its
    input twice. They are dealt out from there, sorted within their partition and
    stored again; a position is the row's number there plus the sizes of the
    earlier partitions, of which there is one row each.
    """
    spark = keyed.sparkSession
    keyed.write.parquet(f"{path}/keyed")
    keyed = spark.read.schema(keyed.schema).parquet(f"{path}/keyed")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("*", F.spark_partition_id().alias("_part"), inside.alias("_row")).write.parquet(f"{path}/placed")
    rows = spark.read.parquet(f"{path}/placed")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("_part", before.alias("_before")), "_part")
    return placed.withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def page(ordered: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered result; past the end it is empty."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def page_after(view: DataFrame, last_prescore: float | None, last_id: str, limit: int = 50) -> DataFrame:
    """The page after a given row in prescore order.

    Unlike an offset this does not produce the skipped rows first, so deep pages
    cost as much as the first one.
    """
    score = F.col("prescore")
    same_or_after = F.col("id") > last_id
    if last_prescore is None:
        later = score.isNull() & same_or_after
    else:
        later = score.isNull() | (score < last_prescore) | ((score == last_prescore) & same_or_after)
    return page(view.filter(later).orderBy(*order_columns("prescore")), limit)


def get_job(view: DataFrame, job_id: str) -> DataFrame:
    """The listing with exactly this id, or no row."""
    return view.filter(F.col("id") == job_id)


def _shared(view: DataFrame) -> list[Column]:
    money = [F.col(f"compensation.{n}").cast("double").alias(f"compensation_{n}") for n in ("minimum", "maximum")]
    plain = ("id", "source", "url", "title", "company", "location_text", "contract_type")
    return [
        *[F.col(n) for n in plain],
        *money,
        F.col("compensation.currency").alias("compensation_currency"),
        F.col("compensation.period").alias("compensation_period"),
        *[F.col(n) for n in ("tags", "posted_at", "first_seen_at", "last_seen_at")],
        effective().alias("eligibility"),
        F.col("eligibility.eligibility").alias("eligibility_from_rules"),
        F.col("eligibility_override"),
        summary(F.col("eligibility")).alias("eligibility_summary"),
        *[F.col(n) for n in ("verification", "match", "prescore", "status", "notes")],
    ]


def list_view(view: DataFrame) -> DataFrame:
    """What a table row shows. The description is left out, so a columnar scan
    never reads it."""
    return view.select(*_shared(view))


def detail_view(view: DataFrame) -> DataFrame:
    return view.select(*_shared(view), "description", F.col("eligibility.dimensions").alias("dimensions"))


def page_totals(view: DataFrame, **filters) -> DataFrame:
    """``total`` counts all listings, ``total_filtered`` those the filters keep."""
    passes = F.lit(True)
    for condition in conditions(**filters):
        passes = passes & F.coalesce(condition, F.lit(False))
    return view.agg(F.count("*").alias("total"), F.count_if(passes).alias("total_filtered"))


def page_envelope(view: DataFrame, limit: int = 50, offset: int = 0, order_by: str = "match_score", **filters) -> tuple[DataFrame, DataFrame]:
    """The page's items and its totals, as two queries."""
    items = list_view(list_jobs(view, order_by=order_by, limit=limit, offset=offset, **filters))
    return items, page_totals(view, **filters).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})


def haystack() -> Column:
    """What a search looks into: title, company, source and tags."""
    return F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("company", F.lit("")), F.col("source"), F.array_join("tags", " ")))


def text_search(view: DataFrame, needle: str) -> DataFrame:
    """Case-blind substring search over title, company, source and tags."""
    wanted = needle.strip().lower()
    if not wanted:
        return view
    return view.filter(haystack().contains(wanted))


def count_jobs(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n"))


def counts_by_eligibility(view: DataFrame) -> DataFrame:
    return view.groupBy(effective().alias("eligibility")).agg(F.count("*").alias("n"))
