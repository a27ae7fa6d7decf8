"""Raw feed records to canonical listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import contract, dates, pay, text, urls
from siftline.operators.dedupe import dedupe_first_wins
from siftline.schema import LISTING, RAW_LISTING

BLANK_TITLE, BAD_URL = "blank_title", "bad_url"


def complete_raw(raw: DataFrame) -> DataFrame:
    """Add the raw columns a feed does not have, as typed nulls."""
    present = set(raw.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RAW_LISTING if f.name not in present}
    return raw.withColumns(missing) if missing else raw


def with_identity(raw: DataFrame) -> DataFrame:
    """Collapsed title, canonical URL, and why a row cannot be kept (or null)."""
    title = text.collapse_whitespace(F.coalesce(F.col("title"), F.lit("")))
    named = raw.withColumns({"title": title, "url": urls.canonical_url(F.col("url"))})
    return named.withColumn("reject_reason", _reject_reason())


def _reject_reason() -> Column:
    return F.when(F.col("title") == "", F.lit(BLANK_TITLE)).when(~urls.is_web_url(F.col("url")), F.lit(BAD_URL))


def usable() -> Column:
    """Whether a raw row will be kept, as a condition on its title and URL."""
    title = text.collapse_whitespace(F.coalesce(F.col("title"), F.lit("")))
    return (title != "") & F.coalesce(urls.is_web_url(urls.canonical_url(F.col("url"))), F.lit(True))


def drop_unusable(raw: DataFrame) -> DataFrame:
    """Rows with a title and an http(s) URL. Nothing else is ever dropped here."""
    return with_identity(raw).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(raw: DataFrame) -> DataFrame:
    """The complement of :func:`drop_unusable`, with the reason."""
    return with_identity(raw).filter(F.col("reject_reason").isNotNull())


def identify(raw: DataFrame) -> DataFrame:
    """Usable rows with their id: all that deduplication needs.

    Cheap, because it looks at title and URL only. Deduplicating here spares the
    text work on every copy that loses.
    """
    return drop_unusable(complete_raw(raw)).withColumn("id", urls.listing_id(F.col("url")))


def shape(identified: DataFrame, now: datetime, keep: tuple[str, ...] = ()) -> DataFrame:
    """The remaining canonical columns; a narrow projection.

    ``keep`` names extra input columns to carry along.
    """
    seen = dates.timestamp_literal(now)

    def tidy(name: str) -> Column:
        return F.nullif(text.collapse_whitespace(F.col(name)), F.lit(""))

    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    shaped = identified.withColumns(
        {
            "company": tidy("company"),
            "description": text.html_to_text(F.coalesce(F.col("description"), F.lit(""))),
            "location_text": tidy("location_text"),
            "compensation": pay.parse_compensation(F.col("compensation_text")),
            "contract_type": contract.parse_contract_type(
                F.col("contract_text"), F.col("title"), F.array_join(tags, " ")
            ),
            "tags": text.normalise_tags(tags),
            "posted_at": F.coalesce(F.col("posted_at"), dates.parse_posted_at(F.col("posted_at_text"), now)),
            "first_seen_at": seen,
            "last_seen_at": seen,
        }
    )
    hashed = shaped.withColumn(
        "content_hash", text.content_hash(F.col("title"), F.col("company"), F.col("description"))
    )
    return hashed.select(*[f.name for f in LISTING], *keep)


def normalise(raw: DataFrame, now: datetime, keep: tuple[str, ...] = ()) -> DataFrame:
    """One canonical listing per usable raw record, duplicates included."""
    return shape(identify(raw), now, keep)


def unique_listings(
    raw: DataFrame, now: datetime, order: Sequence[str] = ("source_priority", "ingest_pos"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Canonical listings, one per id: the same rows as normalising everything
    and deduplicating afterwards."""
    return shape(dedupe_first_wins(identify(raw), order), now, keep)
