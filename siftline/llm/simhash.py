"""Near duplicates by SimHash, joined on a grid of segment bit counts.

A fingerprint has 32 segments of two bits; the bit count of each is 0, 1 or 2.
The Manhattan distance of two such count vectors is at most the Hamming distance
of the fingerprints. The counts fall into six groups of dimensions. Where the
distance is at most two, at most two groups differ, so the pair meets in a grid
cell of the other four: fifteen grids find every pair. Pairs of a cell are
dropped by their Manhattan distance first, then by their differing bits.

Equal fingerprints are one row throughout; only fingerprints are shuffled.

Null texts are empty and have fingerprint zero, which links like any other. Rows
with a null id get a fingerprint and no component and are always kept. Repeated
ids are one document: its component is that of the id. Other columns are passed
over. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import components
from siftline.llm.storage import free_name, from_texts, stored, text_or_empty

LOW_BITS = 0x5555555555555555
#: Segments of each group of dimensions; a cell leaves out two of the six groups.
GROUPS = (5, 5, 5, 5, 6, 6)
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the XXH64 bits of all shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        ends = (starts[shingle:] - 1).tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 segments, two bits each in one long."""
    low = F.lit(LOW_BITS)
    first, second = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))


def manhattan(p: Column, q: Column) -> Column:
    """Distance of two count vectors: counts differ by 2 where only the high bit does."""
    differ, low = p.bitwiseXOR(q), F.lit(LOW_BITS)
    ones, twos = differ.bitwiseAND(low), F.shiftrightunsigned(differ, 1).bitwiseAND(low)
    return F.bit_count(ones) + 2 * F.bit_count(twos.bitwiseAND(F.bitwise_not(ones)))


def grid_masks(distance: int = 2) -> list[int]:
    """One mask per grid: the counts of the groups that a cell keeps."""
    masks, at = [], 0
    for size in GROUPS:
        masks.append(((1 << 2 * size) - 1) << at)
        at += 2 * size
    kept = [sum(c) for c in combinations(masks, len(masks) - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in kept]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs ``(fp_a, fp_b)`` of different fingerprints that differ in few bits."""
    counts = segment_counts(F.col("fp"))
    cells = F.posexplode(F.array(*[counts.bitwiseAND(F.lit(m)) for m in grid_masks(distance)]))
    placed = distinct.select("fp", "id", cells.alias("grid", "cell"))
    a, b = placed.alias("a"), placed.alias("b")
    near = manhattan(segment_counts(F.col("a.fp")), segment_counts(F.col("b.fp"))) <= distance
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    same_cell = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, same_cell & near & exact).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id that links reach."""
    rows = stored(fingerprints(docs, shingle))
    known = rows.filter("doc_id IS NOT NULL")
    distinct = stored(known.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # An id on several rows ties its fingerprints together.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high").select("doc_id")
    tied = known.join(several, "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(links(distinct, distance).unionByName(tied))
    classes = distinct.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    joined = known.join(classes, "fp").select("doc_id", "fp", "component_id")
    return joined.unionByName(rows.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def keep_first(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group of fingerprints that links tie together.

    The row with the smallest id stays, and the smallest hash of its text where an
    id has several texts; of rows equal in both, any one. Ids tie nothing here:
    different texts of one id are different documents. Rows without an id are
    compared with each other only, and one of each group of them stays too.
    """
    names = [free_name(docs, n) for n in ("key_id", "key_null", "key_hash")]
    known = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").cast("long").isNull(), F.xxhash64(text_or_empty())]
    key = [column.alias(name) for column, name in zip(known, names)]
    prints = from_texts("text", "long", lambda: lambda texts: pa.array([fingerprint(t, shingle) for t in texts], pa.int64()))
    rows = stored(docs.select(*key, prints.alias("fp")))
    first = F.min(F.struct(names[0], names[2])).alias("first")
    distinct = stored(rows.groupBy("fp", names[1]).agg(first))
    tied = components(links(distinct.select("fp", F.col("fp").alias("id")).distinct(), distance)).withColumnRenamed("id", "fp")
    classes = distinct.join(tied, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"), names[1]).agg(F.min("first").alias("first"))
    chosen = classes.select(names[1], *[F.col(f"first.{n}").alias(n) for n in (names[0], names[2])])
    # Repeated rows go first, within each task before the only shuffle of texts.
    single = docs.select("*", *key).dropDuplicates(names)
    return single.join(chosen, names, "left_semi").select(*[single[c] for c in docs.columns])
