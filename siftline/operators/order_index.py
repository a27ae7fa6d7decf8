"""Pages of the listing orders from sorted key files.

An index holds, for one order, each listing's id and sort key in files dealt out
by range, and a table with one row per file: its number of rows, the rows before
it, and its last key. A page looks up its files there and opens no others, so
that page 1,000,000 costs as much as the first one. An index belongs to one
snapshot of the view; a new snapshot gets a new folder. Missing scores and dates
come last in each order, ids break ties, repeated rows have a place each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators.views import MAX_PAGE, ORDERS

_DATES = {"posted_at": "posted_at", "last_seen": "last_seen_at"}


def order_key(order_by: str) -> Column:
    """One ascending struct without nulls for a descending order."""
    if order_by not in ORDERS:
        raise ValueError(f"unknown order {order_by!r}")
    if order_by in _DATES:
        values = [F.unix_micros(_DATES[order_by])]
    else:
        values = [F.col(n).cast("double") for n in ("match.score", "prescore")][0 if order_by == "match_score" else 1 :]
    fields = []
    for k, v in enumerate(values):
        fields += [v.isNull().alias(f"missing{k}"), F.coalesce(-v, F.lit(0)).alias(f"down{k}")]
    return F.struct(*fields, F.col("id").alias("id"))


def build_order_index(view: DataFrame, order_by: str, path: str, files: int | None = None) -> None:
    """Write the index of one order under ``path``, into some ``files`` files.

    A stretch of equal scores is split by id like any other. The keys are stored
    unsorted first: dealing out by range reads its input twice."""
    spark, keyed = view.sparkSession, view.select("id", order_key(order_by).alias("key"))
    keyed.write.parquet(f"{path}/unsorted")
    keyed = spark.read.schema(keyed.schema).parquet(f"{path}/unsorted")
    dealt = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = dealt.sortWithinPartitions("key").select("*", F.spark_partition_id().alias("part"), inside.alias("row"))
    rows.write.partitionBy("part").parquet(f"{path}/keys")
    sizes = spark.read.schema(rows.schema).parquet(f"{path}/keys").groupBy("part").agg(F.count("*").alias("n"), F.max("key").alias("last"))
    # One row per file is put in order, never the keys.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).write.parquet(f"{path}/files")


def _check(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")


def _rows_of(spark: SparkSession, path: str, parts: Sequence[tuple[int, int]]) -> DataFrame:
    """``id, key, position`` of the rows of some files, which alone are opened."""
    schema = spark.read.parquet(f"{path}/files").select(F.lit("").alias("id"), F.col("last").alias("key"), F.lit(0).cast("bigint").alias("row")).schema
    if not parts:
        return spark.createDataFrame([], schema).select("id", "key", F.lit(0).cast("bigint").alias("position"))
    pieces = [spark.read.schema(schema).parquet(f"{path}/keys/part={part}").select("id", "key", (F.col("row") + before + 1).alias("position")) for part, before in parts]
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    return whole


def page_at(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page's ``id, key, position`` in order; past the end it is empty."""
    _check(limit)
    if offset < 0:
        raise ValueError("offset must not be negative")
    met = spark.read.parquet(f"{path}/files").filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    # A page's rows lie in at most ``limit`` files.
    parts = [(r["part"], r["before"]) for r in met.select("part", "before").collect()]
    return _rows_of(spark, path, parts).filter((F.col("position") > offset) & (F.col("position") <= offset + limit)).orderBy("position")


def page_following(spark: SparkSession, path: str, key: Sequence, limit: int = 50) -> DataFrame:
    """The page after the row with this ``key``, which an earlier page returned.

    The row itself may be gone by now: later keys are what counts."""
    _check(limit)
    files = spark.read.parquet(f"{path}/files")
    fields = files.schema["last"].dataType.fields
    after = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, fields, strict=True)])
    first = files.filter(F.col("last") > after).agg(F.min_by(F.struct("before", "n"), "part").alias("f")).first()["f"]
    if first is None:
        return _rows_of(spark, path, [])
    met = files.filter((F.col("before") >= first["before"]) & (F.col("before") < first["before"] + first["n"] + limit))
    parts = [(r["part"], r["before"]) for r in met.select("part", "before").collect()]
    return _rows_of(spark, path, parts).filter(F.col("key") > after).orderBy("position").limit(limit)
