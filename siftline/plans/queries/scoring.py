"""Scoring batches, prompts and replies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftline.operators import ranking
from siftline.operators import scoring as S
from siftline.plans import listing_data as L
from siftline.plans import oracle as O
from siftline.plans.registry import query
from siftline.plans.scratch import scratch_dir
from siftline.sources import sinks

SIZE = 10
PROVIDER = "manual"


def _scored(spark, sf):
    nothing = F.lit(None).cast("struct<score:int,reason:string,gaps:array<string>,provider:string,scored_at:timestamp>")
    return ranking.prescore(L.curated(spark, sf), L.PROFILE, L.NOW).withColumn("match", nothing)


def _batched(spark, sf):
    """Every listing in a batch, not only the best; ids only."""
    return S.assign_batches(_scored(spark, sf).select("id", "prescore"), SIZE)


def _written(spark, rows):
    """A stage result that several steps read: written once, as a run does."""
    path = scratch_dir(spark)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _wide(spark, sf):
    """What prompts show, worked out once: the order and the texts both read it."""
    return _written(spark, _scored(spark, sf).select("id", "title", "company", "description", "location_text", "prescore"))


_BATCHED = (
    f"SELECT *, (position - 1) // {SIZE} AS batch_id, CAST((position - 1) % {SIZE} + 1 AS INTEGER) AS batch_index "
    "FROM (SELECT *, row_number() OVER (ORDER BY prescore DESC, id) AS position FROM scored)"
)


@query("scoring_requests", O.with_(f"SELECT id AS job_id, title, company, location_text, md5(description) AS digest FROM listings", "listings"))
def scoring_requests(spark, sf):
    rows = S.scoring_requests(L.listings(spark, sf))
    return rows.select("job_id", "title", "company", "location_text", F.md5("description").alias("digest"))


@query("scoring_requests_limited", O.with_("SELECT id AS job_id, md5(substr(description, 1, 6000)) AS digest FROM listings", "listings"))
def scoring_requests_limited(spark, sf):
    return S.scoring_requests(L.listings(spark, sf), chars=6000).select("job_id", F.md5("description").alias("digest"))


@query("assign_batches", O.with_(f"SELECT id, batch_id, batch_index FROM ({_BATCHED})", "scored"))
def assign_batches(spark, sf):
    return _batched(spark, sf).select("id", "batch_id", "batch_index")


_HEAD = (
    "'### ' || CAST(batch_index AS VARCHAR) || '. ' || title || chr(10) || 'Company: ' || coalesce(company, 'unknown') || chr(10) || "
    "'Location: ' || coalesce(location_text, 'unspecified') || chr(10) || 'Description:' || chr(10) || "
)
_WHOLE = f"CASE WHEN body = '' THEN {O.q(S.NO_DESCRIPTION)} ELSE body END"
_CUT = f"CASE WHEN length(body) > 4000 THEN substr(body, 1, 4000) || chr(10) || '[truncated]' WHEN body = '' THEN {O.q(S.NO_DESCRIPTION)} ELSE body END"
_TEMPLATE = S.DEFAULT_TEMPLATE.replace("{{profile}}", L.PROFILE.resume_text)


def _prompts_sql(description: str) -> str:
    return (
        f"SELECT batch_id, replace({O.q(_TEMPLATE)}, '{{{{jobs}}}}', string_agg({_HEAD}{description}, chr(10) || chr(10) ORDER BY batch_index)) AS prompt "
        f"FROM (SELECT *, {O.strip('description')} AS body FROM ({_BATCHED})) GROUP BY batch_id"
    )


_PROMPTS = _prompts_sql(_WHOLE)


@query("render_prompt", O.with_(f"SELECT batch_id, md5(prompt) AS digest, length(prompt) AS n_chars FROM ({_PROMPTS})", "scored"))
def render_prompt(spark, sf):
    wide = _wide(spark, sf)
    prompts = S.render_prompt(S.assign_batches(wide, SIZE), L.PROFILE.resume_text)
    return prompts.select("batch_id", F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("n_chars"))


@query("render_prompt_limited", O.with_(f"SELECT batch_id, md5(prompt) AS digest FROM ({_prompts_sql(_CUT)})", "scored"))
def render_prompt_limited(spark, sf):
    wide = _wide(spark, sf)
    return S.render_prompt(S.assign_batches(wide, SIZE), L.PROFILE.resume_text, chars=4000).select("batch_id", F.md5("prompt").alias("digest"))


@query(
    "sink_prompt_batches",
    O.with_(f"SELECT batch_id, length(prompt) - length(replace(prompt, chr(10), '')) AS n_lines FROM ({_PROMPTS})", "scored"),
)
def sink_prompt_batches(spark, sf):
    """All batches as files, read back line by line."""
    path = scratch_dir(spark)
    sinks.sink_prompt_batches(S.render_prompt(S.assign_batches(_wide(spark, sf), SIZE), L.PROFILE.resume_text), path)
    lines = spark.read.text(path)
    # A text file ends with a line end of its own.
    return lines.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg((F.count("*") - 1).alias("n_lines"))


# Fixed cases per answer, by (batch + index) % 8.
_KIND = "(batch_id + batch_index) % 8"


def _entry() -> str:
    return (
        f"CASE {_KIND} WHEN 0 THEN '' "
        "WHEN 1 THEN concat('{\"index\":', i, ',\"score\":\"87\",\"reason\":\" fits \",\"gaps\":[\" kafka \",\"\"]}') "
        "WHEN 2 THEN concat('{\"index\":\"', i, '\",\"score\":87.9,\"reason\":null}') "
        "WHEN 3 THEN concat('{\"index\":', i, '.0,\"score\":140,\"gaps\":\"none\"}') "
        "WHEN 4 THEN concat('{\"index\":', i, ',\"score\":true}') "
        "WHEN 5 THEN concat('{\"index\":', i, ',\"score\":61,\"reason\":\"first\"},{\"index\":', i, ',\"score\":12,\"reason\":\"second\"}') "
        "WHEN 6 THEN '{\"index\":99,\"score\":70}' "
        "ELSE concat('{\"index\":', i, ',\"score\":-3,\"reason\":\"no\",\"gaps\":[\"a\",7]},\"stray\"') END"
    )


def replies(spark, sf, batched=None):
    """One reply per batch, with every fault a scorer shows."""
    rows = (_batched(spark, sf) if batched is None else batched).select("batch_id", "batch_index", F.col("batch_index").cast("string").alias("i"))
    entries = rows.select("batch_id", "batch_index", F.expr(_entry()).alias("entry"))
    grouped = entries.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("batch_index", "entry"))).alias("e"))
    texts = F.filter(F.transform("e", lambda x: x["entry"]), lambda t: t != "")
    body = F.concat(F.lit('{"results":['), F.array_join(texts, ","), F.lit("]}"))
    kind = F.col("batch_id") % 6
    reply = (
        F.when(kind == 5, F.lit("I cannot score these."))
        .when(kind == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("Here you go: "), body, F.lit(" Done.")))
        .otherwise(body)
    )
    return grouped.select("batch_id", reply.alias("reply"))


_ANSWERS = (
    "SELECT id, batch_id, batch_index, "
    f"CAST(CASE {_KIND} WHEN 1 THEN 87 WHEN 2 THEN 87 WHEN 3 THEN 100 WHEN 5 THEN 61 WHEN 7 THEN 0 END AS INTEGER) AS score, "
    f"CASE {_KIND} WHEN 1 THEN 'fits' WHEN 5 THEN 'first' WHEN 7 THEN 'no' ELSE 'No reason given.' END AS reason, "
    f"CASE {_KIND} WHEN 1 THEN 'kafka' WHEN 7 THEN 'a,7' ELSE '' END AS gaps "
    f"FROM ({_BATCHED}) WHERE batch_id % 6 <> 5 AND {_KIND} IN (1, 2, 3, 5, 7)"
)


def _answers(spark, sf):
    batched = _written(spark, _batched(spark, sf))
    return batched, S.parse_responses(replies(spark, sf, batched), S.batch_sizes(batched))


@query(
    "extract_json",
    O.with_(
        f"SELECT DISTINCT batch_id, batch_id % 6 <> 5 AS is_object FROM ({_BATCHED})",
        "scored",
    ),
)
def extract_json(spark, sf):
    found = S.extract_json(F.col("reply"))
    return replies(spark, sf).select("batch_id", (found.startswith("{") & found.endswith("}")).alias("is_object"))


@query("parse_responses", O.with_(f"SELECT batch_id, batch_index, score, reason, gaps FROM ({_ANSWERS})", "scored"))
def parse_responses(spark, sf):
    return _answers(spark, sf)[1].withColumn("gaps", F.array_join("gaps", ","))


@query("malformed_batches", O.with_(f"SELECT DISTINCT batch_id FROM ({_BATCHED}) WHERE batch_id % 6 = 5", "scored"))
def malformed_batches(spark, sf):
    return S.malformed_batches(replies(spark, sf)).select("batch_id")


@query("attach_scores", O.with_(f"SELECT id, score, '{PROVIDER}' AS provider FROM ({_ANSWERS})", "scored"))
def attach_scores(spark, sf):
    batched, answers = _answers(spark, sf)
    return S.attach_scores(batched, answers, PROVIDER, L.NOW).select("id", "match.score", "match.provider")


@query("resume_unscored", O.with_(f"SELECT id FROM scored WHERE id NOT IN (SELECT id FROM ({_ANSWERS}))", "scored"))
def resume_unscored(spark, sf):
    batched, answers = _answers(spark, sf)
    return S.resume_unscored(batched, S.attach_scores(batched, answers, PROVIDER, L.NOW)).select("id")


@query("skip_without_resume", O.with_(f"SELECT 'with text' AS profile, count(DISTINCT batch_id) AS batches FROM ({_BATCHED}) UNION ALL SELECT 'without', 0", "scored"))
def skip_without_resume(spark, sf):
    """Batches planned for a profile with and without text."""
    ranked = _scored(spark, sf).select("id", "prescore")
    counts = []
    for name, profile in (("with text", L.PROFILE), ("without", replace(L.PROFILE, resume_text="  "))):
        planned = S.plan_scoring(ranked, profile, SIZE)
        rows = ranked.limit(0).withColumn("batch_id", F.lit(0)) if planned is None else planned
        counts.append(rows.agg(F.lit(name).alias("profile"), F.count_distinct("batch_id").alias("batches")))
    return counts[0].unionByName(counts[1])
