"""Shared storage for intermediate tables, and small helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' word pattern, as a Java and RE2 class.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns into strings at once.
SLICE_BYTES = 2 << 20
_HELD: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may leave that unset; it gets a local
    folder, which then becomes the session's checkpoint folder. On a cluster a
    local folder would lose rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage durably."""
    spark = frame.sparkSession
    path = shared_root(spark)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".strip(":")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """``(doc_id, label)`` with one row per id; repeated marks count as the greater."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    return known.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't use."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def held(name: str, make: Callable[[], object] | None = None):
    """What a worker process keeps between tasks: one operator's cache at a time."""
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        if make is None:
            return None
        _HELD[name] = make()
    return _HELD[name]


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The strings of an array, some megabytes at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        size = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, size + SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def from_texts(text: str, kind: str, task: Callable[[], Callable[[list[str]], pa.Array]]) -> Column:
    """A column worked out from whole texts; nothing else goes to Python.

    ``task()`` is called once per task and gives ``texts -> array``.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("")
        work = task()
        for texts in batches:
            parts = [work(part) for part in slices(texts)]
            yield pa.concat_arrays(parts) if parts else work([])

    return F.arrow_udf(run, kind).asNondeterministic()(text_or_empty(text))


def with_scores(frame: DataFrame, text: str, name: str, scorer: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Add a double column from whole texts, keeping every row."""

    def task():
        score = scorer()
        return lambda texts: pa.array(score(texts), pa.float64())

    return frame.withColumn(name, from_texts(text, "double", task))
