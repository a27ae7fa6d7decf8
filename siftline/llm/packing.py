"""Packing documents into fixed-length training sequences by linear grouping.

Documents become token ids with an end id and are cut only where they are longer
than a sequence. What is then packed is a histogram: how many pieces there are
of each length, at most one row per possible length however large the corpus.

1. Large lengths are sorted and split into groups of equal cardinality; each
   length is rounded up to its group's largest.
2. For these few sizes, configurations (which sizes share a sequence) are chosen
   by linear programming with column generation, rounded down.
3. Actual pieces take the places of the rounded sizes.
4. What is left, and all small pieces, go by best fit into the remaining room,
   longest first; runs of equal sequences are filled together.

The plan is a list of intervals "pieces of this length with these ranks go to
these sequences at this offset". Ranks come from counts per partition and
length, so no task ever sorts or holds the pieces of a common length.

Null texts are empty and give one piece, the end id. Repeated rows are packed as
often as they occur; null ids stay null. Other input columns are ignored. An
empty table gives no piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.encoding import encoder
from siftline.llm.storage import stored, text_or_empty

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, part int, nth long, ids binary"
#: Groups of equal cardinality, and the share of a sequence from which a length is
#: large. All are planned, on the histogram alone, and the fewest sequences win.
SETTINGS = ((48, 1 / 4), (48, 1 / 3), (24, 1 / 2))
#: Sets a length's rank apart in one sorted key; ranks stay far below it.
_RANK = 1 << 44


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), numbered within the
    partition among those of the same length. A scan and no shuffle."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer_path).encode, [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                ids, starts = encode(block.column(1).to_pylist())
                raw = memoryview(np.insert(ids.astype("<u4"), starts[1:], end_id)).cast("B")
                starts = starts + np.arange(len(starts))
                rows = []
                for doc, a, b in zip(block.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    first = (b - a) % capacity or capacity
                    for number, end in enumerate(range(a + first, b + 1, capacity)):
                        begin = max(a, end - capacity) if number else a
                        rows.append((doc, number, begin - a, end - begin, part, seen[end - begin], bytes(raw[4 * begin : 4 * end])))
                        seen[end - begin] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                columns = zip(*rows) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "part", "nth", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def fullest(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest total value (a knapsack over few sizes)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gains = best[room - sizes[fits]] + values[fits]
        k = int(gains.argmax())
        best[room], last[room] = (gains[k], fits[k]) if gains[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
    chosen, room = np.zeros(len(sizes)), capacity
    while room >= smallest:
        if last[room] < 0:
            room -= 1
        else:
            chosen[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Few-size configurations and how many sequences take each, rounded down.

    The linear programme starts from one configuration per size; the simplex
    step enters the configuration that prices best and drops the one that its
    entry empties first.
    """
    columns = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(columns)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        prices = inverse.sum(axis=0)
        worth, entering = fullest(np.maximum(prices, 0), sizes, capacity)
        if prices.min() < -1e-9:  # giving more than is asked for costs nothing
            entering = -np.eye(len(sizes))[int(prices.argmin())]
        elif worth <= 1 + 1e-9:
            break
        direction = inverse @ entering
        ratios = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        amount = amount - direction * ratios[leaving]
        amount[leaving] = ratios[leaving]
        columns[:, leaving] = entering
    real = [(columns[:, j], int(amount[j] + 1e-9)) for j in range(len(sizes)) if columns[:, j].min() >= 0]
    return [(c.astype(int), n) for c, n in real if n > 0]


class Plan:
    """Intervals of equal pieces and the runs of equal sequences they go to."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.intervals: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, how many)
        self.rooms: list[int] = []

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, rank: int, base: int, used: int) -> None:
        self.intervals.append((length, rank, base, used))

    def leave(self, base: int, count: int, used: int) -> None:
        left = self.capacity - used
        if count and left:
            if not self.room[left]:
                insort(self.rooms, left)
            self.room[left].append((base, count))

    def fill(self, length: int, rank: int, count: int) -> None:
        """Best fit for ``count`` pieces of one length."""
        while count:
            k = bisect_left(self.rooms, length)
            left = self.rooms[k] if k < len(self.rooms) else self.capacity
            each = left // length
            if k < len(self.rooms):
                base, n = self.room[left].pop()
                if not self.room[left]:
                    self.rooms.pop(k)
            else:
                n = -(-count // each)
                base = self.open(n)
            used, whole = self.capacity - left, min(n, count // each)
            for layer in range(each if whole else 0):
                self.put(length, rank + layer * whole, base, used + layer * length)
            rank, count = rank + each * whole, count - each * whole
            self.leave(base, whole, used + each * length)
            base, n = base + whole, n - whole
            if n and count:  # fewer are left than the next sequence would hold
                for layer in range(count):
                    self.put(length, rank + layer, base, used + layer * length)
                self.leave(base, 1, used + count * length)
                base, n, count = base + 1, n - 1, 0
            self.leave(base, n, used)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for groups, large in SETTINGS:
        plan = plan_with(counts, capacity, groups, large)
        best = plan if best is None or plan.sequences < best.sequences else best
        if best.sequences == bound:
            break
    return best


def plan_with(counts: dict[int, int], capacity: int, groups: int, large_share: float) -> Plan:
    plan = Plan(capacity)
    if counts.get(capacity):
        plan.put(capacity, 0, plan.open(counts[capacity]), 0)
    large = sorted((n for n in counts if capacity * large_share < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    # Runs (length, first rank, how many) by group; equal rounded sizes share one.
    queues: dict[int, deque] = {}
    done, size = 0, 0
    for n in large:
        rank, left = 0, counts[n]
        while left:
            bound = -(-total * (done * groups // total + 1) // groups)
            if done == -(-total * (done * groups // total) // groups) or not size:
                size = n
            taken = max(1, min(left, bound - done))
            queues.setdefault(size, deque()).append((n, rank, taken))
            rank, left, done = rank + taken, left - taken, done + taken
    if queues:
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([float(sum(run[2] for run in queues[s])) for s in sizes.tolist()])
        for chosen, times in configurations(sizes, demand, capacity):
            _substitute(plan, queues, [s for s, k in zip(sizes.tolist(), chosen) for _ in range(k)], times)
    rest = [run for queue in queues.values() for run in queue] + [(n, 0, c) for n, c in counts.items() if n <= capacity * large_share]
    for length, rank, count in sorted(rest, key=lambda run: (-run[0], run[1])):
        plan.fill(length, rank, count)
    return plan


def _substitute(plan: Plan, queues: dict[int, deque], places: list[int], times: int) -> None:
    """Actual pieces for ``times`` sequences of one configuration."""
    runs = [(plan.open(times), times, 0)]
    for size in places:
        after = []
        for base, n, used in runs:
            while n and queues[size]:
                length, rank, count = queues[size].popleft()
                k = min(n, count)
                plan.put(length, rank, base, used)
                if count > k:
                    queues[size].appendleft((length, rank + k, count - k))
                after.append((base, k, used + length))
                base, n = base + k, n - k
            if n:  # nothing is left of this size: the room stays for best fit
                after.append((base, n, used))
        runs = after
    for base, n, used in runs:
        plan.leave(base, n, used)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, outputs: dict[str, Column] | None = None) -> DataFrame:
    """Every piece with its sequence and offset: ``doc_id, piece, start, length,
    sequence_id, offset`` and the outputs, by default the piece's ``ids``.

    Outputs are expressions over the stored pieces; what they leave out is
    neither read again nor shuffled.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, tokenizer_path, capacity, end_id), compression="zstd")
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    # At most one row per length below the capacity, whatever the corpus.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(totals, capacity)
    table = np.array(sorted(plan.intervals), dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table[:, 0] * _RANK + table[:, 1], table[:, 1], table[:, 2], table[:, 3]))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    extra = outputs or {"ids": F.col("ids")}
    narrow = pieces.select("doc_id", "piece", "start", "length", *[c.alias(n) for n, c in extra.items()], "part", "nth")
    ranked = narrow.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    kept = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bases, offsets = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy().astype(np.int64) * _RANK + rank, side="right") - 1
            placed = [pa.array(bases[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *placed], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_digests(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packing with a CRC-32 of each piece's stored ids in their place."""
    packed = pack(docs, tokenizer_path, capacity, end_id, {"ids_crc32": F.crc32("ids")})
    return packed.withColumn("length", F.col("length").cast("long"))
