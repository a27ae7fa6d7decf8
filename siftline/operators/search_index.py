"""Substring search by posting lists of three-letter groups.

An index holds, under one folder, the searched text of each listing (``texts``),
how many listings hold each group of three characters (``grams``), and the ids
that hold it (``postings``, in folders by the group's hash). A needle of three or
more characters reads the lists of its rarest groups, keeps the ids that are on
all of them, and looks for the needle itself in the texts of these alone. The
result equals the scan's. Shorter needles scan the stored texts. An index belongs
to one snapshot of the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.views import haystack

#: Lists that are intersected; more only shorten a list of ids that is verified anyway.
LISTS = 3
#: Parts of a posting folder, so that a group that every listing holds is many files.
PARTS = 8


def grams(text: Column) -> Column:
    """The distinct groups of three characters, from three readings of the text,
    each in steps of three."""
    readings = [F.regexp_extract_all(text.substr(F.lit(k), F.length(text)), F.lit("(?s)..."), F.lit(0)) for k in (1, 2, 3)]
    return F.array_distinct(F.concat(*readings))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build_search_index(view: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the index under ``path``. Repeated rows of an id are all kept."""
    spark = view.sparkSession
    view.select("id", haystack().alias("haystack")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    posted = texts.select("id", F.explode(grams(F.col("haystack"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    dealt = posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("bucket", "gram", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    if texts.isEmpty():
        spark.createDataFrame([], "gram string, n bigint, bucket int").write.parquet(f"{path}/grams")
        return
    lists = spark.read.schema(posted.schema).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    lists.select("gram", "n", "bucket").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def rarest(spark: SparkSession, path: str, needle: str) -> list[tuple[str, int]] | None:
    """The needle's rarest groups and their folders; None if one is on no list."""
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    known = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return None
    return [(r["gram"], r["bucket"]) for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:LISTS]]


def postings(spark: SparkSession, path: str, gram: str, bucket: int) -> DataFrame:
    """The ids on one group's list; no other folder is opened."""
    rows = spark.read.schema("id string, gram string").parquet(f"{path}/postings/bucket={bucket}")
    return rows.filter(F.col("gram") == gram).select("id")


def search(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """``id`` of every row whose text holds the needle, blind to case and outer blanks."""
    wanted = needle.strip().lower()
    texts = spark.read.schema("id string, haystack string").parquet(f"{path}/texts")
    if len(wanted) >= 3:
        lists = rarest(spark, path, wanted)
        if lists is None:
            return texts.filter(F.lit(False)).select("id")
        ids = postings(spark, path, *lists[0])
        for more in lists[1:]:
            ids = ids.join(postings(spark, path, *more), "id", "left_semi")
        texts = texts.join(ids, "id", "left_semi")
    return texts.filter(F.col("haystack").contains(wanted)).select("id")
