"""The cheap, deterministic score that orders listings. It never drops one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.dates import micros
from siftline.functions.patterns import quote
from siftline.functions.text import searchable_text
from siftline.operators.eligibility import effective_eligibility
from siftline.operators.once import compute_once
from siftline.schema import Profile

# --- Fixed values: weights and decay ---
SKILL_WEIGHT = 0.55
TITLE_WEIGHT = 0.25
RECENCY_WEIGHT = 0.10
ELIGIBILITY_WEIGHT = 0.10
FRESH_DAYS = 7.0
STALE_DAYS = 60.0
SKILL_CAP = 8
OUTCOME_WEIGHTS = {"eligible": 1.0, "unknown": 0.6, "ineligible": 0.0}
# --- End of fixed values ---------------


def skill_overlap(text: Column, profile: Profile) -> Column:
    """Share of the user's skills the text names, saturating at eight."""
    if not profile.skills:
        return F.lit(0.0)
    lowered = F.lower(text)
    hits = F.lit(0)
    for skill in profile.skills:
        word = skill.lower()
        # The boundary classes let "c++" and "c#" stand as words of their own.
        named = lowered.contains(word) & lowered.rlike(rf"(?U)(?<![\w+#]){quote(word)}(?![\w+#])")
        hits = hits + named.cast("int")
    return F.least(F.lit(1.0), hits / F.lit(float(max(1, min(len(profile.skills), SKILL_CAP)))))


def title_affinity(title: Column, profile: Profile) -> Column:
    """1 for a wanted title, 0.5 for a shared word of over three letters."""
    if not profile.titles:
        return F.lit(0.0)
    lowered = F.lower(title)
    whole = F.lit(False)
    for wanted in profile.titles:
        whole = whole | lowered.contains(wanted.lower())
    words = sorted({w for t in profile.titles for w in t.lower().split() if len(w) > 3})
    shared = F.lit(False)
    if words:
        found = F.regexp_extract_all(lowered, F.lit("[a-z+#]+"), F.lit(0))
        shared = F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))
    return F.when(whole, F.lit(1.0)).when(shared, F.lit(0.5)).otherwise(F.lit(0.0))


def recency(posted_at: Column, now: datetime) -> Column:
    """1 within a week, 0 from sixty days on, linear between, 0.5 undated."""
    days = (F.lit(micros(now)) - F.unix_micros(posted_at)) / F.lit(86_400_000_000.0)
    return (
        F.when(posted_at.isNull(), F.lit(0.5))
        .when(days <= FRESH_DAYS, F.lit(1.0))
        .when(days >= STALE_DAYS, F.lit(0.0))
        .otherwise(1.0 - (days - FRESH_DAYS) / (STALE_DAYS - FRESH_DAYS))
    )


def eligibility_weight(outcome: Column) -> Column:
    return (
        F.when(outcome == "eligible", F.lit(OUTCOME_WEIGHTS["eligible"]))
        .when(outcome == "unknown", F.lit(OUTCOME_WEIGHTS["unknown"]))
        .otherwise(F.lit(OUTCOME_WEIGHTS["ineligible"]))
    )


def prescore(view: DataFrame, profile: Profile, now: datetime, name: str = "prescore") -> DataFrame:
    """Add the score in [0, 1], rounded to six places."""
    outcome = effective_eligibility(F.col("eligibility_override"), F.col("eligibility"))
    scored = view.withColumn("_text", searchable_text())
    total = (
        F.lit(SKILL_WEIGHT) * skill_overlap(F.col("_text"), profile)
        + F.lit(TITLE_WEIGHT) * title_affinity(F.col("title"), profile)
        + F.lit(RECENCY_WEIGHT) * recency(F.col("posted_at"), now)
        + F.lit(ELIGIBILITY_WEIGHT) * eligibility_weight(outcome)
    )
    return compute_once(scored, {name: F.round(total, 6)}).drop("_text")


def rank(scored: DataFrame) -> DataFrame:
    """Best first; equal scores by id, so the order never varies between runs."""
    return scored.orderBy(F.col("prescore").desc(), F.col("id").asc())


def rank_positions(scored: DataFrame, name: str = "position", id_prefix: int = 3) -> DataFrame:
    """The 1-based position of every row in rank order, without a global sort.

    The score is the six-decimal one of :func:`prescore`; rows without one come last.

    Rows are grouped by score and by the first id characters. Group sizes give
    each group's start, and only rows inside one group are sorted together.
    Ids are hashes, so even a score shared by a third of all rows splits into
    ``16 ** id_prefix`` even groups. The start of each score is a running sum
    over the distinct six-decimal scores, of which there are at most a million.

    Only id and score are shuffled for this; the sizes and the rows read the
    same shuffle. Other columns are joined back by id.
    """
    # Whole, never-null keys: doubles are normalised before they are hashed and
    # nullable keys get filters of their own, and either would split the shuffle.
    score = F.coalesce(F.round(F.col("prescore") * 1_000_000).cast("bigint"), F.lit(-1))
    part = F.coalesce(F.substring("id", 1, id_prefix), F.lit(""))
    keyed = scored.select("id", score.alias("_score"), part.alias("_part"))
    spread = keyed.repartition("_score", "_part")
    # Counting ids keeps every use of the shuffle identical, so it runs once.
    sizes = spread.groupBy("_score", "_part").agg(F.count("id").alias("_size"))
    per_score = sizes.groupBy("_score").agg(F.sum("_size").alias("_total"))
    before_score = Window.orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_score.select(
        F.col("_score"), F.coalesce(F.sum("_total").over(before_score), F.lit(0)).alias("_score_start")
    )
    before_part = Window.partitionBy("_score").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_score", "_part", F.coalesce(F.sum("_size").over(before_part), F.lit(0)).alias("_part_start")
    )
    inside = Window.partitionBy("_score", "_part").orderBy("id")
    placed = spread.withColumn("_row", F.row_number().over(inside))
    # Both start columns travel on the small side, so rows join on an even key.
    joined = placed.join(offsets.join(starts, "_score"), ["_score", "_part"])
    position = F.col("_score_start") + F.col("_part_start") + F.col("_row")
    value = F.when(F.col("_score") >= 0, F.col("_score") / 1_000_000)
    positions = joined.select("id", value.alias("prescore"), position.cast("bigint").alias(name))
    if set(scored.columns) == {"id", "prescore"}:
        return positions
    return scored.join(positions.drop("prescore"), "id")


def topk_pending(scored: DataFrame, k: int | None) -> DataFrame:
    """The best ``k`` rows that have no match yet, the run's scoring budget; null
    takes all of them, in no order."""
    pending = scored.filter(F.col("match").isNull())
    return pending if k is None else rank(pending).limit(k)
