"""Spelling variants by a dictionary of trie-node pairs.

The distinct words, sorted, are the paths of a trie; so are the reversed words.
Each task numbers the nodes of its sorted range, a new node for each letter after
what a word shares with the one before. A node that two ranges share has two
numbers; the few words at the borders tell which, and the second becomes the first.

A word split at position i is then a pair of integers: the node of what comes
before and the reversed node of what comes after. A word that skips its letter i
and a word that is whole at i have the same pair where they differ by that letter,
and two words that skip a letter have the same pair where only that letter
differs. Equal pairs are exact neighbours, and a pair is shared by no more words
than there are letters, so no group grows with the data.

Null texts have no words; a null id counts as empty text. Repeated rows count
again. Words of any length cost memory in proportion to their length. Other
columns are ignored. Nothing found, no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.storage import stored, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
#: What makes an occurrence lose a letter, and when a word is known.
EVERY, LEAST_LETTERS, LEAST_COUNT, TIMES = 31, 7, 2, 10
NUMBERED = "word_id long, word string, n long, nodes array<long>, fresh array<boolean>, part long, border boolean"


def word_counts(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words as they stand, some with a letter left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))).alias("run"))
    capital = F.col("run").rlike("[A-Z]")
    lowered = runs.withColumn("run", F.when(capital, F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run")))
    hashed = lowered.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def shared_length(a: str, b: str) -> int:
    """Letters that two words have in common at their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 8:  # long words: halve what is compared
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    while low < high and a[low] == b[low]:
        low += 1
    return low


def trie_nodes(words: DataFrame) -> DataFrame:
    """Words with ``nodes``, numbers of all their prefixes from the empty one on
    (stored). ``word_id`` is kept, or given in the order of the words; ``fresh``
    tells where a letter differs from the one before it."""
    given = "word_id" in words.columns

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        start = (part + 1) << 40
        path, before, at, held, made = [start], "", 0, None, 1
        schema = pa.schema([("word_id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_())), ("part", pa.int64()), ("border", pa.bool_())])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows, size = [], 0
            for word, n, given_id in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                shared = shared_length(before, word)
                path = path[: shared + 1] + list(range(start + made, start + made + len(word) - shared))
                made += len(word) - shared
                # A row waits for the next one: the last of a range is a border too.
                if held:
                    rows.append(held)
                fresh = [True, *[a != b for a, b in zip(word, word[1:])]]
                held = (given_id if given else start + at, word, n, path, fresh, part, at == 0)
                before, at, size = word, at + 1, size + len(word)
                if size > 100_000 and rows:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)
        if held:
            yield table([(*held[:-1], True)])

    ordered = words.select("word", "n", (F.col("word_id") if given else F.lit(None).cast("long")).alias("word_id")).repartitionByRange("word").sortWithinPartitions("word")
    return stored(ordered.mapInArrow(number, NUMBERED))


def border_nodes(numbered: DataFrame) -> list[tuple[int, int]]:
    """Second numbers of nodes that ranges share, with their first ones.

    Reads two words a range: their count is that of the partitions.
    """
    rows = sorted(numbered.filter("border").select("part", "word", "nodes").collect(), key=lambda r: (r["part"], r["word"]))
    first_of: dict[int, int] = {}
    for last, first in zip(rows, rows[1:]):
        if last["part"] != first["part"]:
            for old, new in list(zip(last["nodes"], first["nodes"]))[: shared_length(last["word"], first["word"]) + 1]:
                first_of[new] = first_of.get(old, old)
        else:  # one range: its last word keeps the numbers of its first
            pass
    return sorted(first_of.items())


def _renamed(rows: DataFrame, column: str, same: list[tuple[int, int]]) -> DataFrame:
    if not same:
        return rows
    # As many rows as partitions have shared letters at their borders: small.
    names = rows.sparkSession.createDataFrame(same, f"{column} long, first long")
    return rows.join(F.broadcast(names), column, "left").withColumn(column, F.coalesce("first", column)).drop("first")


def neighbours(forward: DataFrame) -> DataFrame:
    """``word_id, near_id, near_n``: all words that one letter sets apart, both ways.

    ``forward`` is ``trie_nodes`` of the distinct words.
    """
    backward = trie_nodes(forward.select("word_id", F.reverse("word").alias("word"), "n"))
    ends = backward.select("word_id", F.col("nodes").alias("ends"))
    both = forward.select("word_id", "n", "nodes", "fresh").join(ends, "word_id")
    length = F.size("fresh")
    skips = F.transform("fresh", lambda new, i: F.struct(F.element_at("nodes", i + 1).alias("p"), F.element_at("ends", length - i).alias("s"), F.when(new, F.lit(1)).otherwise(F.lit(2)).alias("kind")))
    wholes = F.transform("nodes", lambda p, i: F.struct(p.alias("p"), F.element_at("ends", length - i + 1).alias("s"), F.lit(0).alias("kind")))
    pairs = both.select("word_id", "n", F.explode(F.concat(skips, wholes)).alias("e")).select("word_id", "n", "e.p", "e.s", "e.kind")
    pairs = _renamed(_renamed(pairs, "p", border_nodes(forward)), "s", border_nodes(backward))
    # Most pairs are one word's alone.
    group = Window.partitionBy("p", "s")
    shared = stored(pairs.withColumn("size", F.count("*").over(group)).filter("size > 1").drop("size"))
    a, b = shared.alias("a"), shared.alias("b")
    same = (F.col("a.p") == F.col("b.p")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.word_id") != F.col("b.word_id"))
    # Kind 1 skips the first letter of a row of equal ones: each insertion counts once.
    replaced = (F.col("a.kind") > 0) & (F.col("b.kind") > 0)
    inserted = F.col("a.kind") + F.col("b.kind") == 1
    return a.join(b, same & (replaced | inserted)).select(F.col("a.word_id").alias("word_id"), F.col("b.word_id").alias("near_id"), F.col("b.n").alias("near_n"))


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    A form's count is ten times its word's, so roots lie at most some twenty forms
    away and five doublings reach them.
    """
    forward = trie_nodes(word_counts(docs))
    near = neighbours(forward).groupBy("word_id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near_id")).alias("order"))).alias("best"))
    words = forward.select("word_id", "word", "n").join(near, "word_id", "left")
    formed = F.col("best.near_n") >= TIMES * F.col("n")
    known = stored(words.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, -F.col("best.order")).alias("form_id"), F.when(formed, F.col("best.near_n")).alias("form_n")))
    steps = known.filter("form_id IS NOT NULL").select("word_id", F.col("form_id").alias("to"))
    moved = True
    while moved:
        on = steps.select(F.col("word_id").alias("to"), F.col("to").alias("next"))
        steps = stored(steps.join(on, "to", "left").select("word_id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        moved = not steps.filter("moved").isEmpty()
        steps = steps.drop("moved")
    named = known.select(F.col("word_id").alias("to"), F.col("word").alias("name"))
    roots = steps.join(named, "to").select("word_id", F.col("name").alias("root"))
    forms = known.filter("form_id IS NOT NULL").select("word_id", F.col("form_id").alias("to")).join(named, "to").select("word_id", F.col("name").alias("form"))
    told = roots.join(forms, "word_id")
    return known.join(told, "word_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
