"""Token ids as Parquet files that training jobs read selectively.

Layout, one row per document in ascending id order: the id, its number of ids,
its place within the file set, and the ids as a list column. Ids are dictionary
encoded (one dictionary per row group, two bytes an id); the ascending columns
are delta encoded. Row groups and pages have fixed sizes and every column has a
page index, so that a reader of some documents' tokens, or of lengths only,
reads those pages and no others.

Null texts are empty: such a document holds the end id alone. Null ids come
first. Repeated rows are all kept, next to each other. Columns of the input
other than the id and the text are ignored, whatever their names. An empty table
gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.encoding import encoder
from siftline.llm.storage import text_or_empty

FILE_SCHEMA = "doc_id long, part int, within long, n_tokens long, ids array<int>"
#: Bytes of a row group and rows of a page: what a selective read has to fetch.
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_ROWS = 1000
#: Ids that one selective read may name.
MOST_IDS = 1000
DELTA_COLUMNS = ("doc_id", "part", "within", "n_tokens")


def encode_sorted(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Token lists in ascending id order: partition by partition, row by row.

    The texts are shuffled once, before they are encoded: dealing out by range
    reads its input twice, and encoding is the costly part.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, within, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                block = batch.slice(start, 256)
                ids, starts = encode(block.column(1).to_pylist())
                ids = np.insert(ids.astype(np.int32), starts[1:], end_id)
                starts = starts + np.arange(len(starts))
                n = block.num_rows
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.full(n, part, np.int32)), pa.array(within + starts[:-1]), pa.array(np.diff(starts)), lists],
                    names=["doc_id", "part", "within", "n_tokens", "ids"],
                )
                within += int(starts[-1])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in DELTA_COLUMNS},
        "compression": "zstd",
    }
    encode_sorted(docs, tokenizer_path, end_id).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows as written."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int], columns: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """The rows of some documents, with the named columns.

    Each id is a condition of its own on the ascending id column: files and row
    groups whose bounds exclude all ids are skipped, and within the others only
    pages that may hold one are read, of the named columns alone. Unknown ids give
    no row. More than ``MOST_IDS`` ids are for a join with ``read_token_files``.
    """
    wanted = sorted(set(ids))
    if len(wanted) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids; join with read_token_files beyond")
    tests = [F.col("doc_id") == i for i in wanted] or [F.lit(False)]
    while len(tests) > 1:  # in pairs, so that the condition stays shallow
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
    return read_token_files(spark, path).filter(tests[0]).select(*columns)


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Add ``start``: how many ids all earlier documents have.

    ``rows`` are those of the files, with any columns beside ``part`` and
    ``within``. Lengths are summed per partition from the length column alone;
    only those sums, one row for each written partition, are put in order.
    """
    sums = read_token_files(rows.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sums.select("part", before.alias("before")), "part")
    return placed.withColumn("start", F.col("before") + F.col("within")).drop("part", "before", "within")


def id_digests(rows: DataFrame) -> DataFrame:
    """CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            # The buffer itself: offsets count from its first value.
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")).cast("B")
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(crcs, pa.int64())], names=[*kept, "ids_crc32"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(digest, f"{fields}, ids_crc32 long")
