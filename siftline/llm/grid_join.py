"""Similarity join of embeddings in epsilon grid order.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart, and so is
each of their coordinates in any rotated frame. The frame's leading principal
dimensions are cut into cells of width eps; sorted by label and cell, the vectors
form one sequence. It is split into blocks of bounded size, each with the box
that its vectors span. Runs of blocks, runs of those, and so on form a hierarchy of
intervals with boxes of their own. From each label's whole sequence on, only pairs
of intervals whose boxes are no further apart than eps are refined, level by level,
down to pairs of blocks; no interval meets the rest of its label. Pairs of blocks
are gathered in tiles, so that vectors are sent once a tile. A pair of blocks is
joined by halving on in the same way, skipping halves that are provably distant,
and multiplying the rest in double precision.

Equal vectors are one row throughout; at the end each row finds its own by a 128-bit
hash, salted, as one vector may fill a third of the table. A pair of blocks returns how many links
each vector has and the edges of a spanning forest, never all pairs.

Vectors that are null, empty, zero or hold a null or non-finite component, and
vectors without label or id, link with nothing. Vectors of different lengths
never link. Repeated rows are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.components import components
from siftline.llm.storage import stored

#: Leading principal dimensions of the grid, vectors and bytes of a block at most,
#: and the interval length from which halving stops.
DIMS = 6
BLOCK = 1024
BLOCK_BYTES = 2 << 20
LEAF = 128
#: An interval has 2 ** BITS children; a tile has as many blocks on each side.
BITS = 3
#: Parts into which the partners of one interval, or the copies of one vector, are dealt.
SALTS = 8
#: Slack for rounding in the frame; candidates only, links are checked exactly.
SLACK = 1e-6
BLOCK_SCHEMA = "block long, label int, size int, lo array<double>, hi array<double>, ids array<long>, copies array<long>, vectors binary"


def valid() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def frame_of(distinct: DataFrame, size: int) -> np.ndarray:
    """Leading principal directions of the vectors of the given length.

    Sums of products are formed per task and added by Spark: size² numbers.
    """

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), _unit(np.array(batch["v"].tolist(), dtype=float))])
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    rows = distinct.filter(F.col("size") == size).select("v").mapInPandas(moments, "at int, s double")
    total = np.zeros((size + 1) ** 2)
    for r in rows.groupBy("at").agg(F.sum("s").alias("s")).collect():
        total[r["at"]] = r["s"]
    total = total.reshape(size + 1, size + 1)
    n = max(total[0, 0], 1)
    mean = total[0, 1:] / n
    return np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1][:, :DIMS]


def blocks(distinct: DataFrame, eps: float) -> DataFrame:
    """The sequence's blocks. Vectors of a length other than the most common one
    keep their own leading coordinates as the frame."""
    common = distinct.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    main = common["size"] if common else 0
    frame = frame_of(distinct, main) if main else np.zeros((0, 0))

    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for size, rows in batch.groupby("size"):
                unit = _unit(np.array(rows["v"].tolist(), dtype=float))
                point = unit @ frame if size == main else unit[:, :DIMS]
                out.append(rows.assign(point=list(point), cell=list(np.floor(point / eps).astype(int)), vector=[u.tobytes() for u in unit]))
            if out:
                yield pd.concat(out)[["label", "size", "id", "copies", "point", "cell", "vector"]]

    fields = "label int, size int, id long, copies long, point array<double>, cell array<int>, vector binary"
    # Stored, as dealing out by range reads its input twice.
    placed = stored(distinct.mapInPandas(project, fields))
    # A label of a third of all rows is split like any other stretch of the sequence.
    order = ["label", "size", "cell", "id"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def block():
            nonlocal number
            points = np.array([r["point"] for r in held])
            row = {"block": number, "label": key[0], "size": key[1], "lo": points.min(0).tolist(), "hi": points.max(0).tolist(), "ids": [r["id"] for r in held], "copies": [r["copies"] for r in held], "vectors": b"".join(r["vector"] for r in held)}
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        long = pa.list_(pa.int64())
        schema = pa.schema([("block", pa.int64()), ("label", pa.int32()), ("size", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", long), ("copies", long), ("vectors", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["label"], row["size"])
                if held and (now != key or len(held) >= max(1, min(BLOCK, BLOCK_BYTES // (8 * key[1])))):
                    yield block()
                    held = []
                key = now
                held.append(row)
        if held:
            yield block()

    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCK_SCHEMA))


def numbered(table: DataFrame) -> DataFrame:
    """Add ``at``, the block's place in the whole sequence, without gaps.

    Only the number of blocks of each partition is put in order."""
    part = F.shiftright("block", 32)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = table.withColumn("part", part).join(sizes.select("part", before.alias("before")), "part")
    return placed.withColumn("at", F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))).drop("part", "before")


def hierarchy(boxes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each label's whole interval, and the levels from it down to runs of blocks.

    A level has a row for each interval: ``label, size, node, lo, hi`` and ``kids``,
    its at most 2 ** BITS children with their boxes."""
    last = boxes.agg(F.max("node")).first()[0] or 0
    levels: list[DataFrame] = []
    while last >> (BITS * len(levels)):
        ends = [F.array(*[f(F.col(name)[k]) for k in range(DIMS)]).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
        up = F.shiftright("node", BITS).alias("node")
        below = levels[-1] if levels else boxes
        levels.append(stored(below.groupBy("label", "size", up).agg(F.collect_list(F.struct("node", "lo", "hi")).alias("kids"), *ends)))
    return (levels[-1] if levels else boxes), levels[::-1]


def _apart(x: Column, y: Column) -> Column:
    """The squared distance between two boxes."""
    gaps = [F.greatest(x["lo"][k] - y["hi"][k], y["lo"][k] - x["hi"][k], F.lit(0.0)) for k in range(DIMS)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def block_pairs(table: DataFrame, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks of a label, by ``at``, that are not provably distant."""
    sides = [F.array(*[F.coalesce(F.get(name, F.lit(k)), F.lit(0.0)) for k in range(DIMS)]).alias(name) for name in ("lo", "hi")]
    top, levels = hierarchy(stored(table.select("label", "size", F.col("at").alias("node"), *sides)))
    pairs = top.select("label", "size", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels:
        salted = level.select("label", "size", "node", "kids", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        for end, other, kids in (("a", "b", "x"), ("b", "a", "y")):
            side = salted.select("label", "size", F.col("node").alias(end), F.col("kids").alias(kids), "salt")
            pairs = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS))).join(side, ["label", "size", end, "salt"]).drop("salt")
        met = pairs.select("label", "size", F.explode("x").alias("x"), "y").select("label", "size", "x", F.explode("y").alias("y"))
        met = met.filter((F.col("x.node") <= F.col("y.node")) & (_apart(F.col("x"), F.col("y")) <= (eps + SLACK) ** 2))
        pairs = stored(met.select("label", "size", F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs


def _far(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
    return float(gap @ gap) > (eps + SLACK) ** 2


def _boxes_apart(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    return _far(p.min(0), p.max(0), q.min(0), q.max(0), eps)


def links_of(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows link, by halving both intervals until they are distant or short."""
    eps = np.sqrt(2 - 2 * threshold)
    found = np.zeros((len(x), len(y)), bool)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if _boxes_apart(x[a:b], y[c:d], eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            found[a:b, c:d] = x[a:b] @ y[c:d].T >= threshold
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return found


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the rows and columns that link."""
    edges, rows_left, columns_left = [], linked.any(axis=1), linked.any(axis=0)
    while rows_left.any():
        todo = [int(rows_left.argmax())]
        rows_left[todo[0]] = False
        while todo:
            row = todo.pop()
            for column in np.flatnonzero(linked[row] & columns_left).tolist():
                columns_left[column] = False
                edges.append((row, column))
                for other in np.flatnonzero(linked[:, column] & rows_left).tolist():
                    rows_left[other] = False
                    edges.append((other, column))
                    todo.append(other)
    return edges


def link_table(table: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n)``: edges where b is set, else n links that a has.

    Pairs of blocks are dealt out by tile; a block is sent once to each tile where
    it has a near partner. A tile holds at most 2 ** (BITS + 1) blocks."""
    eps = float(np.sqrt(2 - 2 * threshold))

    def join(tile: pa.Table) -> pa.Table:
        rows = {r["at"]: r for r in tile.drop_columns(["vectors"]).to_pylist()}
        buffers = dict(zip(tile.column("at").to_pylist(), tile.column("vectors")))
        x = {at: np.frombuffer(buffers[at].as_buffer()).reshape(len(r["ids"]), -1) for at, r in rows.items()}
        box = {at: (np.array(r["lo"]), np.array(r["hi"])) for at, r in rows.items()}
        ids = {at: np.array(r["ids"], np.int64) for at, r in rows.items()}
        copies = {at: np.array(r["copies"], np.int64) for at, r in rows.items()}
        links = {at: np.zeros(len(i), np.int64) for at, i in ids.items()}
        ends: list[tuple[int, int]] = []
        for p in rows:
            for q in rows:
                if p > q or (p >> BITS, q >> BITS) != (rows[p]["ta"], rows[p]["tb"]) or _far(*box[p], *box[q], eps):
                    continue
                linked = links_of(x[p], x[q], threshold)
                if p == q:
                    np.fill_diagonal(linked, False)
                links[p] += linked @ copies[q]
                if p != q:
                    links[q] += copies[p] @ linked
                ends += [(int(ids[p][i]), int(ids[q][j])) for i, j in forest(linked)]
        nodes = np.concatenate([ids[at][n > 0] for at, n in links.items()])
        counts = np.concatenate([n[n > 0] for n in links.values()])
        a = np.concatenate([nodes, np.array([e[0] for e in ends], np.int64)])
        b = pa.array([None] * len(nodes) + [e[1] for e in ends], pa.int64())
        n = np.concatenate([counts, np.zeros(len(ends), np.int64)])
        return pa.table({"a": pa.array(a), "b": b, "n": pa.array(n)})

    placed = numbered(table)
    pairs = block_pairs(placed.select("label", "size", "at", "lo", "hi"), eps)
    tile = ["label", "size", "ta", "tb"]
    met = pairs.select("label", "size", F.shiftright("a", BITS).alias("ta"), F.shiftright("b", BITS).alias("tb"), F.explode(F.array("a", "b")).alias("at"))
    sent = met.distinct().join(placed.drop("label", "size", "block"), "at")
    return stored(sent.groupBy(*tile).applyInArrow(join, "a long, b long, n long"))


def _key() -> list[Column]:
    """128 bits of a label and its vector; both zeros are the same number."""
    v = F.transform("embedding", lambda x: x + F.lit(0.0))
    return [F.xxhash64("label", v).alias("h"), F.xxhash64(F.lit(1), v, "label").alias("g")]


def similar_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding"))
    good = rows.filter(valid())
    distinct = stored(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
        .select("label", F.size("embedding").alias("size"), "id", "copies", *_key(), F.col("embedding").alias("v"))
    )
    found = link_table(blocks(distinct, float(np.sqrt(2 - 2 * threshold))), threshold)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    classes = components(found.filter("b IS NOT NULL").select("a", "b"))
    decided = distinct.join(counts, "id", "left").join(classes, "id", "left").select(
        "h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    linked = good.select("vec_id", *_key(), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).join(decided, ["h", "g", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(valid(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
