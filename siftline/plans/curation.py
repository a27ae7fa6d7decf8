"""A full run: every stage reads tables and writes one, so each can be redone.

Stages go from cheap to costly. Each result is a Parquet table under
``root/<table>/run=<n>``; a later stage reads the written table instead of the
plan that made it. That bounds the plans, makes each text computation happen
once per run, and leaves finished stages intact when executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.operators import funnel, memo, ranking, reports, scoring, snapshots, verification
from siftline.operators.normalise import complete_raw, unique_listings, usable
from siftline.operators.rules import RuleSet
from siftline.schema import ELIGIBILITY, LISTING, Criteria, Profile
from siftline.sources import registry, sinks
from siftline.sources.payloads import LANDED

# Fixed value: listings of one prompt.
BATCH_SIZE = 10


@dataclass(frozen=True)
class Store:
    """The tables of one curated collection."""

    spark: SparkSession
    root: str

    def path(self, table: str, run: int) -> str:
        return f"{self.root}/{table}/run={run}"

    def write(self, table: str, run: int, rows: DataFrame, **counters: Column) -> DataFrame:
        """Write a stage result and return the stored table.

        A repeated run overwrites its own result only. ``counters`` are aggregates
        gathered while the rows are written; :meth:`counters` reads them.
        """
        if not counters:
            rows.write.mode("overwrite").parquet(self.path(table, run))
            return self.read(table, run)
        seen = Observation()
        observed = rows.observe(seen, *[value.alias(name) for name, value in counters.items()])
        observed.write.mode("overwrite").parquet(self.path(table, run))
        found = self.spark.createDataFrame([(name, int(n or 0)) for name, n in seen.get.items()], "name string, n bigint")
        found.coalesce(1).write.mode("overwrite").json(f"{self.path('counters', run)}/table={table.partition('/')[0]}")
        return self.read(table, run)

    def counters(self, run: int) -> DataFrame:
        """``(name, n, table)`` of a run: a few rows for each stage."""
        return self.spark.read.schema("name string, n bigint, table string").json(self.path("counters", run))

    def read(self, table: str, run: int) -> DataFrame:
        return self.spark.read.parquet(self.path(table, run))

    def latest(self, table: str, value: str, runs: Sequence[int]) -> DataFrame | None:
        """``(id, value)`` over the given runs, the last write of an id winning.

        One scan of the table, pruned to the runs: the plan is the same for one run
        and for a thousand.
        """
        if not runs or not self.exists(table):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("run").isin(*runs))
        return snapshots.latest_by_key(rows, value, seq="run")

    def before(self, table: str, run: int) -> DataFrame | None:
        """What other runs have written to the table; null if none has."""
        if not self.exists(table):
            return None
        return self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("run") != run).drop("run")

    def exists(self, table: str) -> bool:
        """Whether any run has written the table; damaged output is an error."""
        try:
            self.spark.read.parquet(f"{self.root}/{table}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise
        return True


@dataclass(frozen=True)
class Settings:
    profile: Profile
    ruleset: RuleSet
    criteria: Criteria
    verify_limit: int | None = None
    score_limit: int | None = None
    recheck_unknown: bool = False
    batch_size: int = BATCH_SIZE


def store_records(store: Store, run: int, payloads: DataFrame, sources: dict) -> DataFrame:
    """Every record of the run as it arrived, with its raw text: payloads are parsed
    for it once, and listings, problems, counts and outcomes are read from it."""
    readable = F.col("problem").isNull()
    kept = readable & usable()
    rows = complete_raw(registry.union_entries(payloads, sources))
    store.write("records", run, rows, fetched=F.count_if(readable), normalised=F.count_if(kept))
    return stored_records(store, run)


def stored_records(store: Store, run: int) -> DataFrame:
    return store.read("records", run).filter(F.col("problem").isNull()).drop("problem")


def collect(store: Store, run: int, previous: int | None, payloads: DataFrame, sources: dict, now: datetime) -> DataFrame:
    """Landed payloads to the next listings snapshot."""
    raw = store_records(store, run, payloads, sources).drop("raw", LANDED)
    incoming = store.write("incoming", run, unique_listings(raw, now, registry.ORDER), deduplicated=F.count(F.lit(1)))
    entries = store.read("records", run)
    problems = store.write("problems", run, registry.problems_of(entries))
    fetched = raw.select("source")
    spans = reports.source_spans(entries) if LANDED in entries.columns else None
    outcomes = reports.source_outcomes(
        registry.configured(store.spark, sources), fetched, registry.source_errors(problems, fetched), spans
    )
    store.write("source_runs", run, outcomes, errors=F.count("error"))
    current = store.spark.createDataFrame([], LISTING) if previous is None else store.read("listings", previous)
    store.write("changes", run, snapshots.classify_change(incoming, current))
    return store.write("listings", run, snapshots.upsert_snapshot(current, incoming))


def label(store: Store, run: int, settings: Settings, now: datetime) -> DataFrame:
    """Verdicts for the whole snapshot, without touching a feed. What earlier runs
    with the same rules and profile have labelled is not labelled again."""
    listings = store.read("listings", run)
    table = f"verdict_memo/settings={memo.settings_key(settings.profile, settings.ruleset, now)}"
    known = store.before(table, run)
    fresh = memo.label_new(listings, known, settings.profile, settings.ruleset, now)
    new = store.write(table, run, fresh, labelled=F.count(F.lit(1)))
    both = new if known is None else new.unionByName(known)
    outcome = F.col("eligibility.eligibility")
    return store.write("eligibility", run, memo.recall(listings, both), **{e: F.count_if(outcome == e) for e in ELIGIBILITY})


def view(store: Store, run: int, runs: Sequence[int], users: DataFrame | None = None, scored: bool = False) -> DataFrame:
    """Listings of a run with everything known about them.

    ``runs`` are the runs whose verifications and matches count.
    """
    return snapshots.assemble(
        store.read("listings", run),
        eligibility=store.read("eligibility", run),
        verification=store.latest("verification", "verification", runs),
        prescore=store.read("prescore", run) if scored else None,
        matches=store.latest("matches", "match", runs),
        users=users,
    )


def run_all(
    store: Store,
    run: int,
    history: Sequence[int],
    payloads: DataFrame,
    sources: dict,
    fetches: DataFrame,
    settings: Settings,
    now: datetime,
    users: DataFrame | None = None,
) -> DataFrame:
    """All stages in order; returns the run's one-row report.

    ``history`` lists the earlier runs, ``fetches`` the landed page fetches with
    the listing ``id``.
    """
    previous = max(history) if history else None
    collect(store, run, previous, payloads, sources, now)
    label(store, run, settings, now)

    seen = view(store, run, history, users)
    survivors = funnel.kept(seen, settings.criteria, now)
    pending = verification.verify_pending(survivors, settings.verify_limit, recheck_unknown=settings.recheck_unknown)
    store.write("verification", run, verification.verify(pending, fetches, now), verified=F.count(F.lit(1)))

    # Selected again, so that listings just found closed cost nothing further.
    checked = view(store, run, [*history, run], users)
    marked = funnel.apply_filters(checked, settings.criteria, now).select("id", "drop_reason")
    dropped = store.write("drops", run, marked, filtered_out=F.count("drop_reason"))
    kept = checked.join(dropped.filter(F.col("drop_reason").isNull()).select("id"), "id", "left_semi")
    scored = ranking.prescore(kept, settings.profile, now)
    store.write("prescore", run, scored.select("id", "prescore"))

    # Ids and scores are placed first; the texts join the finished batches once.
    matches = store.latest("matches", "match", [*history, run])
    open_ids = store.read("prescore", run)
    if matches is not None:
        open_ids = scoring.resume_unscored(open_ids, matches)
    best = open_ids if settings.score_limit is None else ranking.rank(open_ids).limit(settings.score_limit)
    planned = scoring.plan_scoring(best, settings.profile, settings.batch_size)
    if planned is not None:
        texts = store.read("listings", run).select("id", "title", "company", "description", "location_text")
        batches = store.write("batches", run, planned.join(texts, "id"))
        prompts = scoring.render_prompt(batches, settings.profile.resume_text)
        store.write("prompts", run, prompts)
    return store.write("runs", run, report(store, run))


def export_prompts(store: Store, run: int, path: str) -> None:
    """The run's prompts as one text file per batch."""
    sinks.sink_prompt_batches(store.read("prompts", run), path)


def import_scores(store: Store, run: int, replies: DataFrame, provider: str, now: datetime) -> DataFrame:
    """Merge the scorer's replies to a run's batches; unreadable ones are kept aside."""
    batches = store.read("batches", run)
    store.write("unreadable", run, scoring.malformed_batches(replies))
    answers = scoring.parse_responses(replies, scoring.batch_sizes(batches))
    return store.write("matches", run, scoring.attach_scores(batches, answers, provider, now), scored=F.count(F.lit(1)))


def report(store: Store, run: int) -> DataFrame:
    """One row of the run's counters, as they were gathered while its tables were
    written: no table is read again. Called again after :func:`import_scores` it
    also counts what was scored."""
    named = {stage: "unknown_eligibility" if stage == "unknown" else stage for stage in reports.STAGES}
    return store.counters(run).agg(
        F.lit(run).alias("run_id"),
        *[F.coalesce(F.max(F.when(F.col("name") == s, F.col("n"))), F.lit(0)).alias(n) for s, n in named.items()],
    )
