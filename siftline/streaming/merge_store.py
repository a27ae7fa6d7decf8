"""Listings as generations of bucketed files, merged when they are read.

``root/rows/gen=<n>`` holds what one commit brought, in buckets by id; a line of
``root/manifest``, written last, makes it visible. A scrape is appended and only
its own rows are shuffled: all generations lie in the same buckets, so the merge
on read groups by id without moving anything. Every row knows the first and the
last generation it stands for; source, URL and first sight come from the first,
all else from the last. That rule can be applied in any order and again, so a
row read twice, from a compacted generation and from one it replaces, is no harm.

``compact`` merges the buckets that have gathered many files into one new
generation and leaves the others' files as they are; ``vacuum`` then deletes the
replaced files. A generation that was written but never committed is invisible,
and its number is used again. Incoming rows hold an id once; rows without an id
are left out. An empty batch commits an empty generation.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siftline.schema import LISTING, REFRESHABLE

KEPT = tuple(f.name for f in LISTING if f.name not in REFRESHABLE and f.name != "id")
STORED = StructType([*LISTING.fields, StructField("first_gen", LongType()), StructField("last_gen", LongType())])
MANIFEST = "gen bigint, kind string, stream string, batch bigint, buckets int, rewritten array<int>"
SHUFFLES = "spark.sql.shuffle.partitions"
_BUCKET = re.compile(r"_(\d{5})\.c\d+\.")


@dataclass(frozen=True)
class MergeStore:
    """One collection of listings under a shared folder.

    ``buckets`` is fixed by the first commit: choose it so that a bucket of the
    whole collection fits a task. One writer at a time; any number of readers.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    @property
    def table(self) -> str:
        return f"siftline_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"

    def manifest(self) -> list:
        """All commits in order; empty before the first."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        return sorted(rows, key=lambda r: r["gen"])

    def _register(self, buckets: int) -> None:
        """Tell this session's catalog about the files; the files are the truth."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}, gen BIGINT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (gen) "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{self.root}/rows'"
        )
        place, files = self._place(f"{self.root}/rows")
        files.mkdirs(place)
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.table)

    def _size(self, commits: list) -> int:
        return commits[0]["buckets"] if commits else self.buckets

    def generations(self, commits: list) -> list[int]:
        """Committed generations that still hold a bucket no later one replaced."""
        size, replaced, live = self._size(commits), set(), []
        for commit in reversed(commits):
            own = set(commit["rewritten"]) if commit["kind"] == "compact" else set(range(size))
            if own - replaced:
                live.append(commit["gen"])
            if commit["kind"] == "compact":
                replaced |= own
        return sorted(live)

    def rows(self) -> DataFrame:
        """Stored rows of all live generations, bucket by bucket."""
        commits = self.manifest()
        if not commits:
            return self.spark.createDataFrame([], STORED)
        self._register(self._size(commits))
        return self.spark.table(self.table).filter(F.col("gen").isin(self.generations(commits))).drop("gen")

    def current(self) -> DataFrame:
        """The newest committed listings. No shuffle of what is stored."""
        return merged(self.rows()).select(*LISTING.names)

    def done(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch, or a later one of it, is committed."""
        return any(c["stream"] == stream and c["batch"] >= batch for c in self.manifest() if c["kind"] == "batch")

    def _commit(self, rows: DataFrame, commits: list, kind: str, stream: str | None, batch: int | None, rewritten: Sequence[int]) -> int:
        gen, size = (commits[-1]["gen"] + 1 if commits else 1), self._size(commits)
        self._register(size)
        columns = ", ".join(f"`{n}`" for n in STORED.names)
        view = f"{self.table}_incoming"
        stamped = rows if kind == "compact" else rows.withColumns({c: F.lit(gen).cast("long") for c in ("first_gen", "last_gen")})
        # One file a bucket; what an uncommitted attempt left is overwritten.
        stamped.select(*STORED.names).repartition(size, "id").createOrReplaceTempView(view)
        # With a shuffle partition a bucket, rows that were dealt by id to be made unique
        # already lie as the table wants them and are not shuffled again.
        before = self.spark.conf.get(SHUFFLES)
        self.spark.conf.set(SHUFFLES, size)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (gen = {gen}) SELECT {columns} FROM {view}")
        finally:
            self.spark.conf.set(SHUFFLES, before)
        self.spark.catalog.dropTempView(view)
        line = self.spark.createDataFrame([(gen, kind, stream, batch, size, list(rewritten))], MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return gen

    def upsert(self, incoming: DataFrame, stream: str = "batch", batch: int | None = None) -> int | None:
        """Add a scrape's unique listings; a batch already committed is skipped."""
        commits = self.manifest()
        if batch is not None and self.done(stream, batch):
            return None
        return self._commit(incoming.filter("id IS NOT NULL"), commits, "batch", stream, batch, ())

    def files(self) -> dict[tuple[int, int], list[str]]:
        """Files on disk by generation and bucket: as many as buckets written."""
        commits = self.manifest()
        if not commits:
            return {}
        self._register(self._size(commits))
        known, found = {c["gen"] for c in commits}, {}
        for path in self.spark.table(self.table).inputFiles():
            gen = int(re.search(r"/gen=(\d+)/", path)[1])
            if gen in known:
                found.setdefault((gen, int(_BUCKET.search(path)[1])), []).append(path)
        return found

    def compact(self, most_files: int = 8) -> int | None:
        """Merge the buckets that have more files than this into a new generation."""
        commits = self.manifest()
        live = self._replaced(commits)
        files = {k: v for k, v in self.files().items() if k not in live}
        counts = Counter(bucket for (_, bucket), paths in files.items() for _ in paths)
        chosen = sorted(b for b, n in counts.items() if n > most_files)
        if not chosen:
            return None
        paths = [p for (_, bucket), own in files.items() if bucket in chosen for p in own]
        return self._commit(merged(self.spark.read.schema(STORED).parquet(*paths)), commits, "compact", None, None, chosen)

    @staticmethod
    def _replaced(commits: list) -> set[tuple[int, int]]:
        """Generation and bucket of everything that a compaction replaced."""
        return {(old["gen"], b) for c in commits if c["kind"] == "compact" for old in commits if old["gen"] < c["gen"] for b in c["rewritten"]}

    def vacuum(self) -> int:
        """Delete replaced files; call it when no reader is older than the compaction."""
        replaced = self._replaced(self.manifest())
        doomed = [p for key, paths in self.files().items() if key in replaced for p in paths]
        for path in doomed:
            place, files = self._place(path)
            files.delete(place, False)
        return len(doomed)

    def remove(self, path: str) -> None:
        """Delete a folder, if it is there."""
        place, files = self._place(path)
        files.delete(place, True)

    def _place(self, path: str):
        """A path and its file system, as Spark reaches it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def merged(rows: DataFrame) -> DataFrame:
    """One row per id from any generations of it."""
    rest = [n for n in REFRESHABLE if n != "id"]
    grouped = rows.groupBy("id").agg(
        F.min_by(F.struct(*KEPT), "first_gen").alias("kept"), F.max_by(F.struct(*rest), "last_gen").alias("fresh"),
        F.min("first_gen").alias("first_gen"), F.max("last_gen").alias("last_gen"),
    )
    return grouped.select("id", *[F.col(f"kept.{n}").alias(n) if n in KEPT else F.col(f"fresh.{n}").alias(n) for n in LISTING.names if n != "id"], "first_gen", "last_gen")

