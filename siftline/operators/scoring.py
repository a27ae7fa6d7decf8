"""Scoring as data: requests in batches, prompts as text, replies merged by id.

The scorer itself is outside. It reads rendered batches and leaves one reply per
batch; nothing here assumes that a reply is complete or even well-formed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftline.functions import coerce
from siftline.functions.dates import timestamp_literal
from siftline.functions.text import strip
from siftline.operators.ranking import rank_positions
from siftline.schema import MATCH, Profile

# --- Fixed values: fallback texts -------------------------------
TRUNCATED = "\n[truncated]"
NO_PROFILE = "(no profile provided)"
NO_DESCRIPTION = "(no description provided)"
NO_REASON = "No reason given."
# --- End of fixed values ---------------------------------------

DEFAULT_TEMPLATE = """Rate how well each listing below fits the candidate.

Candidate:
{{profile}}

Listings:
{{jobs}}

Answer with one JSON object and nothing else:
{"results": [{"index": 1, "score": 0, "reason": "one sentence", "gaps": ["missing requirement"]}]}
Use each listing's number as its index, a whole score from 0 to 100, and leave
out any listing you cannot judge.
"""


def scoring_requests(ranked: DataFrame, *keep: str, chars: int | None = None) -> DataFrame:
    """The part of a listing the scorer sees: its whole description, or ``chars`` of it."""
    description = F.col("description") if chars is None else F.substring("description", 1, chars)
    return ranked.select(
        F.col("id").alias("job_id"),
        "title",
        "company",
        description.alias("description"),
        "location_text",
        *keep,
    )


def assign_batches(scored: DataFrame, size: int) -> DataFrame:
    """Add ``batch_id`` and the 1-based ``batch_index``, in rank order."""
    ordinal = rank_positions(scored, "_ordinal")
    zero_based = F.col("_ordinal") - 1
    return ordinal.withColumns(
        {
            "batch_id": F.call_function("div", zero_based, F.lit(size)).cast("bigint"),
            "batch_index": (F.pmod(zero_based, F.lit(size)) + 1).cast("int"),
        }
    ).drop("_ordinal")


def _block(index: Column, title: Column, company: Column, location: Column, description: Column, chars: int | None) -> Column:
    shown = body = strip(description)
    if chars is not None:
        shown = F.when(F.length(body) > chars, F.concat(F.substring(body, 1, chars), F.lit(TRUNCATED))).otherwise(body)

    def or_else(c: Column, fallback: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))

    return F.concat(
        F.lit("### "), index.cast("string"), F.lit(". "), title,
        F.lit("\nCompany: "), or_else(company, "unknown"),
        F.lit("\nLocation: "), or_else(location, "unspecified"),
        F.lit("\nDescription:\n"), or_else(shown, NO_DESCRIPTION),
    )


def render_prompt(batched: DataFrame, profile_text: str, template: str = DEFAULT_TEMPLATE, chars: int | None = None) -> DataFrame:
    """``(batch_id, prompt)``: one text per batch of requests.

    Descriptions are whole unless ``chars`` limits them. A group holds one batch,
    so no group grows with the number of listings.
    """
    blocks = batched.select(
        "batch_id",
        "batch_index",
        _block(F.col("batch_index"), F.col("title"), F.col("company"), F.col("location_text"), F.col("description"), chars).alias("block"),
    )
    grouped = blocks.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("batch_index", "block"))).alias("blocks"))
    jobs = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    head = template.replace("{{profile}}", profile_text.strip() or NO_PROFILE)
    return grouped.select("batch_id", F.replace(F.lit(head), F.lit("{{jobs}}"), jobs).alias("prompt"))


def extract_json(reply: Column) -> Column:
    """The reply's JSON object: inside a code fence, or between outer braces."""
    trimmed = strip(reply)
    fence = r"(?s)\A\s*```(?:json|JSON)?\s*\n(.*?)\n?\s*```\s*\z"
    inner = F.when(trimmed.rlike(fence), strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    return F.when(inner.rlike(r"(?s)\{.*\}"), F.regexp_extract(inner, r"(?s)\{.*\}", 0)).otherwise(inner)


def _whole_number(entry: Column, path: str) -> Column:
    """87, 87.9 and "87" all count; booleans and words do not. Truncates."""
    kind = F.coalesce(coerce.kind(coerce.at(entry, path)), F.lit(""))
    text = strip(F.try_variant_get(entry, path, "string"))
    # The pattern also keeps NaN and Java's float suffixes out of the cast.
    written = F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text)
    numeric = kind.rlike(r"\A(STRING|BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    value = written.try_cast("double")
    # Far beyond any index or score; keeps the cast to a whole number in range.
    # ``least`` and ``greatest`` skip nulls, so an unreadable value is left out first.
    bounded = F.greatest(F.lit(-1e15), F.least(F.lit(1e15), value)).cast("bigint")
    return F.when(numeric & value.isNotNull(), bounded)


def _display(value: Column) -> Column:
    kind = coerce.kind(value)
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def _with_results(replies: DataFrame) -> DataFrame:
    parsed = replies.withColumn("_reply", F.try_parse_json(extract_json(F.col("reply"))))
    results = F.when(coerce.is_array(coerce.at(F.col("_reply"), "$.results")), F.try_variant_get("_reply", "$.results", "array<variant>"))
    return parsed.withColumn("_results", results).drop("_reply")


def malformed_batches(replies: DataFrame) -> DataFrame:
    """Replies without a readable ``results`` list. Each costs only its batch."""
    return _with_results(replies).filter(F.col("_results").isNull()).drop("_results")


def parse_responses(replies: DataFrame, batch_sizes: DataFrame) -> DataFrame:
    """``(batch_id, batch_index, score, reason, gaps)`` of the usable answers.

    An index outside the batch or a missing score drops the entry; scores are
    clamped; of repeated answers for one index the first counts.
    """
    entries = (
        _with_results(replies)
        .select("batch_id", F.posexplode_outer("_results").alias("_at", "_entry"))
        .filter(coerce.is_object(F.col("_entry")))
    )
    reason = F.try_variant_get("_entry", "$.reason", "string")
    reason_kind = coerce.kind(coerce.at(F.col("_entry"), "$.reason"))
    absent = reason.isNull() | (reason == "") | ((reason_kind != "STRING") & reason.isin("0", "0.0", "false", "[]", "{}"))
    gaps = F.filter(
        F.transform(F.try_variant_get("_entry", "$.gaps", "array<variant>"), lambda g: strip(_display(g))), lambda g: g != ""
    )
    shaped = entries.select(
        "batch_id",
        "_at",
        _whole_number(F.col("_entry"), "$.index").cast("bigint").alias("batch_index"),
        _whole_number(F.col("_entry"), "$.score").alias("_score"),
        F.when(absent, F.lit(NO_REASON)).otherwise(strip(reason)).alias("reason"),
        F.when(coerce.is_array(coerce.at(F.col("_entry"), "$.gaps")), gaps)
        .otherwise(F.array().cast("array<string>"))
        .alias("gaps"),
    )
    valid = shaped.join(batch_sizes.select("batch_id", "batch_size"), "batch_id").filter(
        F.col("batch_index").between(1, F.col("batch_size")) & F.col("_score").isNotNull()
    )
    first = Window.partitionBy("batch_id", "batch_index").orderBy("_at")
    return (
        valid.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .select(
            "batch_id",
            F.col("batch_index").cast("int").alias("batch_index"),
            F.greatest(F.lit(0), F.least(F.lit(100), F.col("_score"))).cast("int").alias("score"),
            "reason",
            "gaps",
        )
    )


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_id").agg(F.count("*").alias("batch_size"))


def attach_scores(batched: DataFrame, answers: DataFrame, provider: str, now: datetime) -> DataFrame:
    """``(id, match)``: answers joined back to listings by batch and index.

    A listing the scorer left out is absent; it gets no invented score.
    """
    keys = batched.select("id", "batch_id", "batch_index")
    match = F.struct(
        "score", "reason", "gaps", F.lit(provider).alias("provider"), timestamp_literal(now).alias("scored_at")
    ).cast(MATCH)
    return keys.join(answers, ["batch_id", "batch_index"]).select("id", match.alias("match"))


def plan_scoring(ranked_pending: DataFrame, profile: Profile, size: int) -> DataFrame | None:
    """The run's batches, or null when the profile has no text to score against."""
    if not profile.has_resume:
        return None
    return assign_batches(ranked_pending, size)


def resume_unscored(scored: DataFrame, matches: DataFrame) -> DataFrame:
    """Listings without a stored match: what an interrupted run still owes."""
    return scored.join(matches.select("id"), "id", "left_anti")
