"""Conversation prefix trie by whole-sequence collapse.

Identical conversations collapse into one weighted sequence with a list of the
conversations that end there. A sequence that other sequences go on from is a
proper prefix; an anti-join drops these, and what is left are the leaves. Nodes
are the weighted prefixes of the distinct sequences, summed up.

A prefix is known by its depth and 128 bits: the exclusive or, over its turns, of
hashes of place and turn. It can be taken over segments of a conversation and
joined up, so that a conversation of a third of all rows is numbered, hashed and
summed in many tasks. Texts are only sorted and stored; everything else moves
keys and counts.

Every node belongs to the smallest conversation through it, and so does all of
that conversation's path below. Savings below a node are then its own path's rest
and the whole path owned by each other sequence through it: no list of ancestors.

Rows without conv_id are left out. Null roles and texts are empty. Turns stand by
number, null first; rows of one number by role and text (32 and 64 characters),
then by their digest. Repeated rows are turns of their own. Other columns are
ignored. No conversations, no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.storage import stored

#: Turns of one conversation that a window holds at once.
SEGMENT = 4096
#: Bytes of conversation numbers in one row of an end list.
LIST_BYTES = 1 << 16
KEY = ["depth", "ka", "kb"]


@dataclass
class Turns:
    """Sequences to collapse.

    ``rows``: conv_id, depth (from 1), length, a, b (hashes of place and turn),
    n_bytes, at (its text's place in ``texts``). ``lengths``: conv_id, length.
    """

    rows: DataFrame
    lengths: DataFrame
    texts: DataFrame


@dataclass
class Trie:
    """``nodes``: key, conv_id, parent_conv_id, counts. ``ends``: key, first
    conversation and numbers of those that end there, comma-joined, some 64 KB a
    row, in ascending order."""

    nodes: DataFrame
    ends: DataFrame
    turns: Turns

    def with_texts(self) -> DataFrame:
        """The nodes with role and text of their last turn (null for the root)."""
        places = self.turns.rows.select("conv_id", "depth", "at")
        return self.nodes.join(places, ["conv_id", "depth"], "left").join(self.turns.texts.select("at", "role", "text"), "at", "left").drop("at")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """The turns in order, each with its place ``at``: partition and row (stored)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).filter("conv_id IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    keyed = rows.withColumns({"digest": digest, "n_bytes": F.octet_length("text").cast("long"), "row": F.monotonically_increasing_id()})
    # The row number splits even a pile of equal rows; their order is no matter.
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64), F.col("digest"), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.drop("row").withColumn("at", F.monotonically_increasing_id()))


def _numbered(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What turns a place into a turn's number, per conversation and partition,
    and every conversation's length. Both are stored."""
    part = F.shiftright("at", 33).alias("part")
    spans = placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(own).alias("length")))
    return spans, spans.filter("before = 0").select("conv_id", "length")


def _hashes(depth: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth.cast("long"), F.col("digest")).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def _with_numbers(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """``pos`` (from 0) of every turn; a long conversation meets its spans by partition."""
    light = placed.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "digest", "n_bytes")
    return light.join(spans, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "first", "before")


def as_they_are(conversations: DataFrame) -> Turns:
    """The conversations themselves."""
    placed = sorted_turns(conversations)
    spans, lengths = _numbered(placed)
    depth = F.col("pos") + 1
    rows = _with_numbers(placed, spans).select("conv_id", depth.alias("depth"), "length", *_hashes(depth), "n_bytes", "at")
    return Turns(rows, lengths, placed)


def with_shared_openings(conversations: DataFrame, group: int = 5, most: int = 9) -> Turns:
    """Conversations rebuilt from groups of ``group`` neighbouring numbers.

    Conversation c starts with the first h turns of the group's first
    conversation, c - c % group, and goes on with its own turns after its first
    h; h is the CRC-32 of c's decimal digits modulo ``most``.
    """
    placed = sorted_turns(conversations)
    spans, lengths = _numbered(placed)
    base, taken = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    openers = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    known = lengths.select("conv_id", F.col("length").alias("own"), base.alias("base"), taken.alias("h")).join(openers, "base", "left")
    opening = F.least("h", F.coalesce("base_length", F.lit(0)))
    built = F.when(F.col("base") == F.col("conv_id"), F.col("own")).otherwise(opening + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    known = stored(known.select("conv_id", "base", "h", opening.alias("opening"), built.alias("length")))
    numbered = _with_numbers(placed, spans.drop("length").join(known, "conv_id"))
    is_base = F.col("base") == F.col("conv_id")
    depth = F.when(is_base, F.col("pos") + 1).otherwise(F.col("opening") + F.col("pos") - F.col("h") + 1)
    own = numbered.filter(is_base | (F.col("pos") >= F.col("h"))).select("conv_id", depth.alias("depth"), "length", "digest", "n_bytes", "at")
    # At most ``most - 1`` turns of a base go to at most two groups' members.
    first = numbered.filter(is_base & (F.col("pos") < most - 1)).select("base", "pos", "digest", "n_bytes", "at")
    members = known.filter(~is_base).select("conv_id", "base", "h", "length")
    shared = members.join(first, "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "digest", "n_bytes", "at")
    rows = own.unionByName(shared).select("conv_id", "depth", "length", *_hashes(F.col("depth")), "n_bytes", "at")
    return Turns(rows, known.select("conv_id", "length"), placed)


def running(rows: DataFrame, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Running aggregates along each conversation, by depth, this row included.

    ``totals`` maps a new column to (column, ``bit_xor`` or ``sum``). Windows hold
    a segment of ``SEGMENT`` depths; full segments' results are carried over.
    Depths of a conversation have no gaps.
    """
    segment = F.floor((F.col("depth") - 1) / SEGMENT).cast("long")
    within = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = {name: F.expr(f"{how}({column})").over(within) for name, (column, how) in totals.items()}
    first = stored(rows.withColumn("segment", segment).withColumns(inner))
    full = first.filter(F.col("depth") % SEGMENT == 0).select("conv_id", (F.col("segment") + 1).alias("segment"), *totals)
    along = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    carried = full.select("conv_id", "segment", *[F.expr(f"{how}({name})").over(along).alias(f"carried_{name}") for name, (_, how) in totals.items()])
    # The carry of a last, short segment is that of the full ones before it.
    joined = first.join(carried, ["conv_id", "segment"], "left")
    added = lambda name, how: F.col(name).bitwiseXOR(F.coalesce(f"carried_{name}", F.lit(0))) if how == "bit_xor" else F.col(name) + F.coalesce(f"carried_{name}", F.lit(0))
    return joined.withColumns({name: added(name, how) for name, (_, how) in totals.items()}).drop(*[f"carried_{n}" for n in totals])


def _end_lists(finals: DataFrame) -> DataFrame:
    """Conversation numbers of each sequence in order, in rows of bounded size."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "first_conv", "n", "ids"]
        key, ids, size, rows = None, [], 0, []
        for batch in batches:
            for *now, conv in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now != key or size > LIST_BYTES:
                    if ids:
                        rows.append((*key, int(ids[0]), len(ids), ",".join(ids)))
                    key, ids, size = now, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, int(ids[0]), len(ids), ",".join(ids))], names=names)

    ordered = finals.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    return stored(ordered.mapInArrow(listed, "depth long, ka long, kb long, first_conv long, n long, ids string"))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each sequence's comma-joined list, streamed over its rows."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, state, rows = [*KEY, "ends_sha256"], None, None, []
        for batch in batches:
            for *now, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if now != key:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=names)

    grouped = ends.select(*KEY, "first_conv", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "first_conv")
    return grouped.mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def _by_segment(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """Sequences once for each segment of their path."""
    last = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / SEGMENT).cast("long")
    return sequences.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"), *columns)


def prefix_trie(turns: Turns) -> Trie:
    """The trie of all sequences, with counts of its nodes."""
    whole = running(turns.rows, {"ka": ("a", "bit_xor"), "kb": ("b", "bit_xor")})
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    finals = whole.filter("depth = length").select(*KEY, "conv_id").unionByName(turns.lengths.filter("length = 0").select(*zero, "conv_id"))
    sequences = stored(finals.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")))

    light = whole.select("conv_id", "segment", *KEY, F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "n_bytes")
    none = F.lit(None).cast("long")
    paths = light.join(_by_segment(sequences, ["weight"]), ["conv_id", "segment"]).drop("segment")
    roots = sequences.select("conv_id", *zero, none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("n_bytes"), "weight")
    nodes = stored(paths.unionByName(roots).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    ).withColumn("saves", (F.col("n_convs") - 1) * F.col("n_bytes")))
    children = stored(nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children")))
    # A sequence whose node has children is a proper prefix; the others are leaves.
    leaves = sequences.join(children, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.sum("saves").alias("owned"))
    rated = stored(sequences.join(leaves, "conv_id", "left").join(owned, "conv_id", "left").select("conv_id", *KEY, F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("owned", F.lit(0)).alias("owned")))
    through = light.select("conv_id", "segment", *KEY).join(_by_segment(rated, ["leaf", "owned"]), ["conv_id", "segment"]).drop("segment")
    through = through.unionByName(rated.select("conv_id", *zero, "leaf", "owned"))
    below = through.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("owned"))
    # The root saves nothing and has no place on a path of turns.
    spent = running(nodes.filter("depth > 0").select("conv_id", *KEY, "saves"), {"spent": ("saves", "sum")}).select(*KEY, "spent")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(below, KEY).join(spent, KEY, "left").join(children, KEY, "left").join(parents, ["depth", "pa", "pb"], "left")
    found = joined.select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("owned") - F.coalesce("spent", F.lit(0)) + F.col("saves")).alias("saved_tokens"),
    )
    return Trie(found, _end_lists(finals), turns)


def digests(trie: Trie) -> DataFrame:
    """The nodes, each with the SHA-256 of the conversations that end there."""
    none = hashlib.sha256(b"").hexdigest()
    joined = trie.nodes.join(end_digests(trie.ends), KEY, "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
