"""Records as they arrived, retained as VARIANT.

A record's JSON text is parsed once, when it is stored. Files hold one source
each, so that the writer finds that source's common fields and stores them as
typed columns of their own; a read by path then opens those columns alone, and
conditions on them reach the scan. What is no JSON stays in ``raw_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.once import compute_once


def retain(records: DataFrame, path: str) -> None:
    """Store records with ``source`` and the JSON text ``raw``; a run's own folder."""
    parsed = compute_once(records, {"_raw": F.try_parse_json("raw")})
    text = F.when(F.col("_raw").isNull(), F.col("raw"))
    rows = parsed.withColumn("raw_text", text).drop("raw").withColumnRenamed("_raw", "raw")
    rows.write.mode("errorifexists").partitionBy("source").parquet(path)


def read_retained(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """The retained records. ``columns`` are those of the records that were stored;
    naming a source in a filter skips the other sources' files."""
    kept = [f for f in columns.fields if f.name != "raw"]
    return spark.read.schema(T.StructType([*kept, T.StructField("raw", T.VariantType()), T.StructField("raw_text", T.StringType())])).parquet(path)


def at(path: str, kind: str = "string") -> Column:
    """The value under a path such as ``$.pay.min``, null where it is missing or of
    a kind that has no such value. Its columns alone are read."""
    return F.try_variant_get("raw", path, kind)
