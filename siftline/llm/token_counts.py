"""Token counts by source, language and tokenizer version, kept up to date by
signed deltas.

A change feed has one row per change: ``seq`` orders the changes of a batch,
``op`` is upsert or delete. A commit takes each document's last change, looks up
the counts that the document had after all earlier batches, and writes

* ``counts/batch=N/bucket=B``: what each changed document counts from now on,
  in buckets by id and sorted by id, and
* ``deltas/batch=N``: per source, language and version the sum of new minus old.

Then one row in ``commits/batch=N`` makes the batch visible. A batch that is
committed again changes nothing; one that broke off is written afresh, since
nothing reads what has no commit row. Totals are sums of deltas, so a commit
never reads the texts of earlier batches. Of their counts it reads the buckets
that its own ids fall into, and there only row groups within its span of ids.

Null sources and languages are groups of their own. Null texts are empty. A
change without an id counts as a document that can't be revised: it is added. A
delete of an unknown document adds nothing. Repeated changes of an id in a batch
count once, the last by ``seq`` and, where that ties, the one of greater counts.
Empty batches commit with no delta. Columns of the feed that aren't named above
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.storage import WORD, text_or_empty

KEYS = ("source", "lang")
COUNTS = "doc_id long, source string, lang string, live int, tokens map<string,long>, chars long, bucket int, batch long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long, batch long"
COMMITS = "n_changes long, batch long"
#: Letters, single digits, and runs of anything else between white space.
WORD_PARTS = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]+"

#: Tokenizer versions as columns over a text.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORD)).cast("long"),
    "word-parts-1": lambda text: F.regexp_count(text, F.lit(WORD_PARTS)).cast("long"),
}


class Rollup:
    """A rollup stored under one folder of shared storage.

    ``buckets`` stays the same for a folder's whole life; a bucket of the largest
    batch should suit one task."""

    def __init__(self, spark: SparkSession, root: str, tokenizers: dict[str, Callable[[Column], Column]] | None = None, buckets: int = 64):
        self.spark, self.root, self.tokenizers, self.buckets = spark, root.rstrip("/"), tokenizers or TOKENIZERS, buckets
        for name, schema in (("counts", COUNTS), ("deltas", DELTAS), ("commits", COMMITS)):
            # The folders exist from the start, so that reading is never a guess.
            inner = "/bucket=-1" if name == "counts" else ""
            spark.createDataFrame([], schema).drop("batch", "bucket").write.mode("append").parquet(f"{self.root}/{name}/batch=-1{inner}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        return self._read("commits", COMMITS).select("batch").distinct()

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.commits(), "batch", "left_semi")

    def _write(self, frame: DataFrame, name: str, batch: int, *by: str) -> None:
        frame.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def earlier(self, batch: int) -> DataFrame:
        """Committed counts that the batch's ids may have had before."""
        new = self._read("counts", COUNTS).filter((F.col("batch") == batch) & F.col("doc_id").isNotNull())
        span = new.agg(F.collect_set("bucket").alias("buckets"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
        met = F.col("bucket").isin(span["buckets"]) & F.col("doc_id").between(span["least"], span["most"])
        return self._committed("counts", COUNTS).filter((F.col("batch") != batch) & met).join(new.select("doc_id"), "doc_id", "left_semi")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply one batch once; False if it had been committed before."""
        if self.commits().filter(F.col("batch") == batch).count():
            return False
        text = F.when(F.col("op") == "delete", F.lit("")).otherwise(text_or_empty())
        counted = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "seq",
            (F.col("op") != "delete").cast("int").alias("live"),
            F.create_map(*[x for name, count in self.tokenizers.items() for x in (F.lit(name), count(text))]).alias("tokens"),
            F.length(text).cast("long").alias("chars"),
        )
        # The greatest struct is kept before the shuffle: one row per id and task.
        versions = [F.col("tokens")[name] for name in self.tokenizers]
        order = F.struct("seq", "live", "chars", *versions, F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
        row = F.struct("source", "lang", "live", "tokens", "chars")
        last = counted.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by(row, order).alias("r")).select("doc_id", "r.*")
        last = last.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))
        # Rows without id are never looked up, and stay in the tasks that they are in.
        unnamed = counted.filter("doc_id IS NULL AND live = 1").drop("seq").withColumn("bucket", F.lit(-1))
        self._write(last.repartition("bucket").sortWithinPartitions("bucket", "doc_id").unionByName(unnamed), "counts", batch, "bucket")
        new = self._read("counts", COUNTS).filter(F.col("batch") == batch)
        old = self.earlier(batch).groupBy("doc_id").agg(F.max_by(row, "batch").alias("r")).select("r.*")
        self._write(self._summed(new, 1).unionByName(self._summed(old, -1)), "deltas", batch)
        self._write(new.agg(F.count("*").alias("n_changes")), "commits", batch)
        return True

    @staticmethod
    def _summed(counts: DataFrame, sign: int) -> DataFrame:
        rows = counts.filter("live = 1").select(*KEYS, "chars", F.explode("tokens").alias("tokenizer", "n"))
        sums = {"n_docs": F.count("*"), "n_tokens": F.sum("n"), "n_chars": F.sum("chars")}
        return rows.groupBy(*KEYS, "tokenizer").agg(*[(sign * c).cast("long").alias(k) for k, c in sums.items()])

    def totals(self) -> DataFrame:
        """Sums over all committed deltas; groups without documents are left out."""
        sums = [F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        return self._committed("deltas", DELTAS).groupBy(*KEYS, "tokenizer").agg(*sums).filter("n_docs > 0")
