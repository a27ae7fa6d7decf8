"""Change detection, snapshot merging and user-owned state.

Listings, derived columns and the user's edits live in separate tables keyed by
id. A scrape only ever produces a listings snapshot, so there is no path by
which it could overwrite a status, a note or an override.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.schema import ELIGIBILITY, LISTING, REFRESHABLE, STATUSES, USER_FIELDS

CHANGES = ("inserted", "updated", "unchanged")
#: Parts of a listing's patches.
PATCH_SALTS = 32


def classify_change(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, change)``: inserted, updated (other content hash) or unchanged."""
    known = current.select("id", F.col("content_hash").alias("_known"))
    joined = incoming.select("id", "content_hash").join(known, "id", "left")
    change = (
        F.when(F.col("_known").isNull(), F.lit("inserted"))
        .when(F.col("_known") != F.col("content_hash"), F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    return joined.select("id", change.alias("change"))


def upsert_report(changes: DataFrame) -> DataFrame:
    """One row: inserted, updated, unchanged and their total."""
    return changes.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES], F.count("*").alias("total")
    )


def upsert_snapshot(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next listings snapshot.

    New ids are added. Known ids take the incoming source-derived columns, also
    when these became null, and keep source, url and first-seen time. Rows the
    scrape did not bring stay as they are. Both sides hold an id once, so the
    join key cannot be skewed.
    """
    fresh = incoming.select("id", F.struct(*[f.name for f in LISTING if f.name != "id"]).alias("_new"))
    stored = current.select("id", F.struct(*[f.name for f in LISTING if f.name != "id"]).alias("_old"))
    merged = stored.join(fresh, "id", "full_outer")

    def column(name: str) -> Column:
        if name in REFRESHABLE:
            value = F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col("_old")[name])
        else:
            value = F.when(F.col("_old").isNotNull(), F.col("_old")[name]).otherwise(F.col("_new")[name])
        return value.alias(name)

    return merged.select("id", *[column(f.name) for f in LISTING if f.name != "id"])


def known_content_hashes(current: DataFrame) -> DataFrame:
    return current.select("content_hash").distinct()


def latest_by_key(writes: DataFrame, value: str, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last write per key. Aggregation combines before the shuffle, so a key
    written millions of times reaches the reducer once per task."""
    return writes.groupBy(key).agg(F.max_by(value, seq).alias(value))


def user_event(ids: DataFrame, field: str, value: Column, seq: Column) -> DataFrame:
    """Rows for the append-only user event log. A null value clears the field."""
    if field not in USER_FIELDS:
        raise ValueError(f"{field!r} is not a user-owned field")
    return ids.select("id", F.lit(field).alias("field"), value.cast("string").alias("value"), seq.cast("bigint").alias("seq"))


def user_state(events: DataFrame) -> DataFrame:
    """Current ``(id, status, notes, eligibility_override)``, the last write of
    each field winning. A cleared field reads as null again."""
    latest = events.groupBy("id").agg(
        *[
            F.max_by(
                F.struct(F.col("value")), F.when(F.col("field") == name, F.col("seq"))
            ).getField("value").alias(name)
            for name in USER_FIELDS
        ]
    )
    return latest.withColumn("status", F.coalesce("status", F.lit("new")))


def assemble(
    listings: DataFrame,
    *,
    eligibility: DataFrame | None = None,
    verification: DataFrame | None = None,
    prescore: DataFrame | None = None,
    matches: DataFrame | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Listings with their derived and user-owned columns.

    Every side table holds an id once; a missing table gives typed nulls.
    """
    from siftline.schema import ELIGIBILITY_VERDICT, MATCH, VERIFICATION

    view = listings
    sides: Sequence[tuple[DataFrame | None, dict]] = (
        (eligibility, {"eligibility": ELIGIBILITY_VERDICT}),
        (verification, {"verification": VERIFICATION}),
        (prescore, {"prescore": "double"}),
        (matches, {"match": MATCH}),
        (users, {"status": "string", "notes": "string", "eligibility_override": "string"}),
    )
    for table, columns in sides:
        if table is None:
            view = view.withColumns({n: F.lit(None).cast(t) for n, t in columns.items()})
        else:
            view = view.join(table.select("id", *columns), "id", "left")
    nothing_known = F.struct(F.lit("unknown").alias("eligibility"), F.array().alias("dimensions")).cast(ELIGIBILITY_VERDICT)
    return view.withColumns(
        {"status": F.coalesce("status", F.lit("new")), "eligibility": F.coalesce("eligibility", nothing_known)}
    )


def check_patches(patches: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``problem`` to ``(id, body, seq)`` patches; null marks the valid ones.

    ``body`` is a JSON object of user-owned fields. An unknown field, a value
    outside its domain or an unknown id makes a patch invalid as a whole. A
    listing may have any share of the patches: the known ids among them are
    found from distinct ids and meet the patches in ``PATCH_SALTS`` parts each.
    """
    salted = patches.withColumn("_salt", F.pmod(F.xxhash64("body", "seq"), F.lit(PATCH_SALTS)).cast("int"))
    parsed = salted.withColumn("_fields", F.from_json("body", "map<string,string>"))
    patched = patches.select("id").distinct().join(listings.select("id"), "id", "left_semi")
    known = patched.select("id", F.explode(F.sequence(F.lit(0), F.lit(PATCH_SALTS - 1))).alias("_salt"), F.lit(True).alias("_known"))
    fields = F.map_keys("_fields")
    status, override = F.try_element_at("_fields", F.lit("status")), F.try_element_at("_fields", F.lit("eligibility_override"))
    problem = (
        F.when(F.col("_fields").isNull(), F.lit("unreadable"))
        .when(F.exists(fields, lambda f: ~f.isin(*USER_FIELDS)), F.lit("unknown field"))
        .when(status.isNotNull() & ~status.isin(*STATUSES), F.lit("bad status"))
        .when(override.isNotNull() & ~override.isin(*ELIGIBILITY, "clear"), F.lit("bad override"))
        .when(F.col("_known").isNull(), F.lit("unknown id"))
    )
    return parsed.join(known, ["id", "_salt"], "left").withColumn("problem", problem).drop("_known", "_salt")


def patch_events(checked: DataFrame) -> DataFrame:
    """User events of the valid patches.

    An omitted or null field is left alone; an empty note and the override
    ``clear`` become null.
    """
    valid = checked.filter(F.col("problem").isNull())
    exploded = valid.select("id", F.explode_outer("_fields").alias("field", "_value"), "seq").filter(F.col("_value").isNotNull())
    cleared = ((F.col("field") == "notes") & (F.col("_value") == "")) | (
        (F.col("field") == "eligibility_override") & (F.col("_value") == "clear")
    )
    return exploded.select("id", "field", F.when(~cleared, F.col("_value")).alias("value"), F.col("seq").cast("bigint").alias("seq"))
