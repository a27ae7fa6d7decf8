"""Which feeds exist, in which order they win, and how they are read together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.sources import feeds

Reader = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Feed:
    read: Reader
    problems: Reader
    per_company: bool = False
    #: Companies whose boards are read; empty: every landed payload.
    companies: tuple[str, ...] = ()
    #: Records and problems from one reading; without it, from two.
    entries: Reader | None = None

    def landed(self, payloads: DataFrame) -> DataFrame:
        """Payloads of the configured companies; prunes ``company=`` folders."""
        return payloads.filter(F.col("company").isin(*self.companies)) if self.companies else payloads


REGISTRY: dict[str, Feed] = {
    "remoteok": Feed(feeds.read_remoteok, feeds.problems_remoteok, entries=feeds.entries_remoteok),
    "remotive": Feed(feeds.read_remotive, feeds.problems_remotive, entries=feeds.entries_remotive),
    "weworkremotely": Feed(feeds.read_weworkremotely, feeds.problems_weworkremotely, entries=feeds.entries_weworkremotely),
    "hackernews": Feed(feeds.read_hackernews, feeds.problems_hackernews, entries=feeds.entries_hackernews),
    "greenhouse": Feed(feeds.read_greenhouse, feeds.problems_greenhouse, per_company=True, entries=feeds.entries_greenhouse),
    "lever": Feed(feeds.read_lever, feeds.problems_lever, per_company=True, entries=feeds.entries_lever),
    "ashby": Feed(feeds.read_ashby, feeds.problems_ashby, per_company=True, entries=feeds.entries_ashby),
}
# First-wins order within and across feeds.
ORDER = ("source_priority", "board", "payload_id", "record_pos")


def register(name: str, feed: Feed) -> None:
    """Add a feed of your own; a taken name is an error."""
    if name in REGISTRY:
        raise ValueError(f"feed {name!r} exists")
    REGISTRY[name] = feed


def available_sources() -> tuple[str, ...]:
    return tuple(sorted(REGISTRY))


def build_sources(names: Iterable[str], companies: dict[str, Sequence[str]] | None = None) -> dict[str, Feed]:
    """The chosen feeds in order. An unknown name is an error; a per-company
    feed without companies is left out."""
    chosen: dict[str, Feed] = {}
    for name in names:
        if name not in REGISTRY:
            raise ValueError(f"unknown source {name!r}; available: {', '.join(available_sources())}")
        feed = REGISTRY[name]
        slugs = tuple(c.strip() for c in (companies or {}).get(name, ()) if c.strip())
        if feed.per_company and not slugs:
            continue
        chosen[name] = replace(feed, companies=slugs) if feed.per_company else feed
    return chosen


def union_sources(payloads: DataFrame, sources: dict[str, Feed]) -> DataFrame:
    """Raw listings of all chosen feeds with their ``source_priority``."""
    parts = [feed.read(feed.landed(payloads)).withColumn("source_priority", F.lit(i)) for i, feed in enumerate(sources.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_entries(payloads: DataFrame, sources: dict[str, Feed]) -> DataFrame:
    """Raw listings as in :func:`union_sources` and, with a ``problem`` and little
    else, the payloads that could not be read. Each payload is parsed once."""
    parts = []
    for i, feed in enumerate(sources.values()):
        landed = feed.landed(payloads)
        if feed.entries is not None:
            rows = feed.entries(landed)
        else:
            failed = feed.problems(landed).withColumnRenamed("company", "board")
            rows = feed.read(landed).unionByName(failed, allowMissingColumns=True)
        parts.append(rows.withColumn("source_priority", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def problems_of(entries: DataFrame) -> DataFrame:
    """``(source, company, payload_id, problem)`` as :func:`source_problems` has it."""
    failed = entries.filter(F.col("problem").isNotNull())
    return failed.select("source", F.col("board").alias("company"), "payload_id", "problem")


def source_problems(payloads: DataFrame, sources: dict[str, Feed]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [feed.problems(feed.landed(payloads)) for feed in sources.values()])


def source_errors(problems: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(source, failed_payloads, error)`` of the feeds with failed payloads.

    One bad payload among others is a problem of its own, not of the feed: only a
    feed from which no row came has an error.
    """
    per_company = [n for n, f in REGISTRY.items() if f.per_company]
    counts = fetched.groupBy("source").agg(F.count("*").alias("_rows"))
    failures = problems.groupBy("source").agg(F.count("*").alias("_failed"), F.min("problem").alias("_first"))
    isolated = F.col("source").isin(*per_company)
    joined = failures.join(counts, "source", "left")
    message = F.when(
        isolated, F.concat(F.lit("all "), F.col("_failed").cast("string"), F.lit(" configured boards failed: "), F.col("_first"))
    ).otherwise(F.col("_first"))
    error = F.when(F.col("_rows").isNull(), message)
    return joined.select("source", F.col("_failed").alias("failed_payloads"), error.alias("error"))


def configured(spark, sources: dict[str, Feed]) -> DataFrame:
    rows = [(name, i) for i, name in enumerate(sources)]
    return spark.createDataFrame(rows, "source string, source_priority int")
