"""Benchmark questions in documents, also with other numbers, names or units.

Texts become templates: numbers, names (capitalised words, wherever they stand)
and units after numbers turn into typed placeholders, everything else is lower
case without punctuation. Windows of five words find places where a document may
hold an item; there the item is laid against the document word by word. Words
agree as placeholders of one kind or as equal words, so that a copy in other case
or other line breaks agrees too. Within one alignment, one value of the item must
always stand against the same value of the document; alignments that break this
are dropped. A document holds an item if what is left covers at least 0.8 of all
the item's windows.

A window is looked for by up to two keys: with names as words, and with names as
placeholders. Windows with fewer than three literal words, or names of the item's
own value, say little. They are looked for with their values, and count where
these are equal, or as templates where the document has 0.8 of the item's other
windows. So an item without literal words is found where it is copied, not with
other values.

Everything is DataFrame functions. The benchmark's windows are broadcast where
their counted number allows, and joined by shuffle beyond it.

Texts of fewer than five words have one window, all of them: they are found in
documents that hold nothing else. Null texts are empty and match nothing.
Documents with a null id are told apart by a hash of their text; items with a null
id are not searched for. Repeated rows give one result, and so do several texts
with one item id, of which the best covered counts. Columns other than the ids and
texts are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import free_name, stored, text_or_empty
from siftline.operators.once import compute_once

WIDTH = 5
COVERAGE = 0.8
#: Literal words that a window needs, and the share of slot values that may clash.
LITERALS = 3
CLASHES = 0.1
#: Benchmark windows up to which they, and then the items, are broadcast.
BROADCAST_ROWS = 500_000
#: Marks of a name, a number and a unit; the value follows the mark.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Words below these are names, and slots of any kind.
NAMES, SLOTS = "\x02", "\x04"
_UNITS = (
    "km|cm|mm|m|mi|miles?|ft|feet|inch(?:es)?|kg|mg|g|lbs?|oz|tons?|l|ml|liters?|litres?|s|sec(?:onds?)?|min(?:utes?)?|h|hrs?|hours?|days?"
    "|weeks?|months?|years?|mph|kmh|dollars?|cents?|euros?|pounds?|percent|degrees?|watts?|volts?|hz|kb|mb|gb|tb"
)


#: What stands between words; points and the like stay between digits.
_SIMPLE = r"[^\p{L}\p{M}\p{N}\x01-\x03]+"
_BETWEEN = r"(?:[^\p{L}\p{M}\p{N}\x01-\x03.,:/]|[.,:/](?!\d)|(?<!\d)[.,:/])+"


def words_of(text: Column) -> Column:
    """Lower-case words; the values of slots follow their mark."""
    marks = NAME + NUMBER + UNIT
    plain = F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "   ")).otherwise(text)
    named = F.regexp_replace(plain, r"(?<![\p{L}\p{M}\p{N}])(\p{Lu}[\p{L}\p{M}]+)", NAME + "$1")
    numbered = F.regexp_replace(named, r"(?<![\p{L}\p{N}.,])(\d+(?:[.,:/]\d+)*)(?![\p{L}\p{N}])", NUMBER + "$1")
    apart = F.regexp_replace(numbered, rf"(?i)(?<![\p{{L}}\p{{N}}.,])(\d+(?:[.,]\d+)*)({_UNITS})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1 {UNIT}$2")
    united = F.regexp_replace(apart, rf"(?i)({NUMBER}[0-9.,:/]*[0-9])[\s\p{{Z}}]+{NAME}?({_UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    # Most texts hold no digit and are spared three passes.
    digits = text.rlike("[0-9]")
    return F.array_remove(F.when(digits, F.split(F.lower(united), _BETWEEN)).otherwise(F.split(F.lower(named), _SIMPLE)), "")


def split_texts(frame: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, words`` of the texts that have words."""
    texts = frame.select(*keys, text_or_empty().alias("text"))
    return compute_once(texts, {"words": words_of(F.col("text"))}).drop("text").filter(F.size("words") > 0)


def bare(word: Column) -> Column:
    """The word as if it were no name."""
    return F.when(word < NAMES, F.substring(word, 2, 1 << 30)).otherwise(word)


def hashed(frame: DataFrame) -> DataFrame:
    """Adds hashes of words: as they are, with numbers and units blank, all slots blank."""
    blank = lambda w, otherwise: F.when(w < SLOTS, F.substring(w, 1, 1)).otherwise(otherwise)
    named = lambda w: F.when(w < NAMES, F.substring(w, 2, 1 << 30)).otherwise(blank(w, w))
    return compute_once(frame, {
        "exact": F.when(F.exists("words", lambda w: w.between(NUMBER, SLOTS)), F.transform("words", lambda w: F.xxhash64(bare(w)))),
        "named": F.transform("words", lambda w: F.xxhash64(named(w))),
        "masked": F.transform("words", lambda w: F.xxhash64(blank(w, w))),
    })


def places_of(words: str) -> Column:
    """First words of the windows; a short text has one window."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))


def window_hashes(name: str) -> Column:
    """A hash for each window; a short text's one window has the words there are."""
    return F.transform(places_of(name), lambda i: F.xxhash64(*[F.get(name, i + k) for k in range(WIDTH)]))


def slots_in(below: str, above: str) -> Column:
    """For each window the number of its words between two marks."""
    return F.transform(places_of("words"), lambda i: F.size(F.filter(F.slice("words", i + 1, WIDTH), lambda w: (w >= above) & (w < below))))


def keyed_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_hash, words, slots, fixed``: slots of each window, and those but names."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text_or_empty()).alias("item_hash"), "text")
    split = split_texts(items.filter("item_id IS NOT NULL"), ["item_id", "item_hash"]).drop_duplicates(["item_id", "item_hash"])
    return stored(compute_once(split, {"slots": slots_in(SLOTS, NAME), "fixed": slots_in(SLOTS, NUMBER)}))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, item_hash, size, item_pos, hash``: each window by the keys it is looked for,
    with the number of the item's words."""
    most = WIDTH - LITERALS
    keys = F.arrays_zip("slots", "fixed", window_hashes("named").alias("named"), window_hashes("masked").alias("masked"), F.coalesce(window_hashes("exact"), F.array()).alias("exact"))
    of = ["item_id", "item_hash", "size"]
    rows = hashed(items).withColumn("size", F.size("words")).select(*of, F.posexplode(keys).alias("item_pos", "w")).select(*of, "item_pos", "w.*")
    plain = F.when(F.col("fixed") <= most, F.col("named")).otherwise(F.col("exact"))
    other = F.when((F.col("slots") > F.col("fixed")) & (F.col("slots") <= most), F.array(plain, "masked")).otherwise(F.array(plain))
    return stored(rows.select(*of, "item_pos", F.explode(other).alias("hash")).distinct())


def document_windows(docs: DataFrame, key: list[str]) -> DataFrame:
    """``key, pos, hash``: every key by which an item may look for a window."""
    words = hashed(split_texts(docs, key)).drop("words")
    keys = F.array(window_hashes("named"), window_hashes("masked"), F.coalesce(window_hashes("exact"), F.array()))
    each = words.select(*key, F.explode(keys).alias("hashes"))
    return each.select(*key, F.posexplode("hashes").alias("pos", "hash"))


def agreement(item: Column, doc: Column) -> Column:
    """3 for equal words, 2 for equal numbers or units, 1 for slots of one kind, else 0."""
    same = (item < SLOTS) & (doc < SLOTS) & (F.substring(item, 1, 1) == F.substring(doc, 1, 1))
    return F.coalesce(F.when(bare(item) == bare(doc), F.when(item.between(NUMBER, SLOTS), 2).otherwise(3)).when(same, 1), F.lit(0))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds.

    ``doc_id, text_hash, item_id, n_windows, n_matched, coverage, n_slots, verbatim``:
    ``verbatim`` where every slot has the item's own value.
    """
    items = keyed_items(benchmark)
    asked = item_windows(items)
    if asked.count() <= BROADCAST_ROWS:
        asked, items = F.broadcast(asked), F.broadcast(items)
    key, of = ["doc_id", "text_hash"], ["item_id", "item_hash"]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    met = document_windows(named, key).join(asked, "hash")
    found = stored(met.select(*key, *of, "size", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    # Texts are read again only where a window was met, once per text.
    places = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct(*of, "size", "shift")).alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))
    texts = split_texts(named.join(places, same).drop_duplicates(key), [*key, "places"])
    # Words of the item before the document's first one have nothing to stand against.
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    stretch = F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.col("size") - skipped)
    # Only the stretch beside the item leaves the text, however many places it has.
    laid = texts.select(*key, "words", F.explode("places").alias("p")).select(*key, "words", "p.*").select(*key, *of, skipped.alias("skipped"), stretch.alias("doc"))
    cut = laid.join(items, of).select(*key, *of, "slots", "fixed", "skipped", F.slice("words", F.col("skipped") + 1, F.size("words") - F.col("skipped")).alias("item"), "doc")
    # A document that ends within the item is padded with nulls, which agree with nothing.
    agreed = compute_once(cut, {"level": F.zip_with("item", "doc", agreement)})
    windows = compute_once(agreed, {"whole": F.transform(places_of("item"), lambda i: F.array_min(F.slice("level", i + 1, WIDTH)))})
    # Names with the item's value are as good as literals.
    told = lambda i: F.size(F.filter(F.slice("level", i + 1, WIDTH), lambda v: v < 3)) <= WIDTH - LITERALS
    windows = compute_once(windows, {"sure": F.transform("whole", lambda v, i: (v >= 2) | ((v == 1) & told(i)))})

    def held(met: Column) -> Column:
        """Places of the item whose windows were met."""
        return F.filter(F.transform(met, lambda m, i: F.when(m, i + F.col("skipped"))), lambda i: i.isNotNull())

    def pairs(met: Column) -> Column:
        """Values of the item's slots in these windows, with the document's."""
        first = lambda k: F.greatest(k - WIDTH + 1, F.lit(0))
        inside = lambda k: F.exists(F.slice(met, first(k) + 1, k - first(k) + 1), lambda m: m)
        both = F.zip_with("item", "doc", lambda a, b: F.when(a < SLOTS, F.struct(bare(a).alias("item"), bare(b).alias("doc"))))
        return F.array_distinct(F.filter(F.transform(both, lambda s, k: F.when(inside(k), s)), lambda s: s.isNotNull()))

    loose = F.transform("whole", lambda v: v >= 1)
    rows = compute_once(windows, {"sure_slots": pairs(F.col("sure")), "all_slots": pairs(loose)})
    steady = lambda s: F.size(s) <= (1 + CLASHES) * F.size(F.array_distinct(F.transform(s, lambda x: x["item"])))
    own = lambda s: F.forall(s, lambda x: x["item"] == x["doc"])
    fits = steady("all_slots")
    groups = rows.filter(steady("sure_slots")).select(
        *key, *of, "slots", "fixed", held(F.col("sure")).alias("sure"), F.when(fits, held(loose)).otherwise(held(F.col("sure"))).alias("loose"),
        *[F.struct(F.size(s).alias("n"), own(s).alias("own")).alias(name) for name, s in (("sure_values", F.col("sure_slots")), ("all_values", F.when(fits, F.col("all_slots")).otherwise(F.col("sure_slots"))))],
    )
    united = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
    merged = groups.groupBy(*key, *of).agg(
        F.first("slots").alias("slots"), F.first("fixed").alias("fixed"), united("sure"), united("loose"),
        *[F.struct(F.max(f"{v}.n").alias("n"), F.min(f"{v}.own").alias("own")).alias(v) for v in ("sure_values", "all_values")],
    )
    # What numbers alone tell is no evidence for other numbers.
    few = lambda name: F.filter(F.transform(name, lambda n, i: F.when(n <= WIDTH - LITERALS, i)), lambda i: i.isNotNull())
    worded = F.array_intersect("sure", few("fixed"))
    template = (F.size(worded) > 0) & (F.size(worded) >= COVERAGE * F.size(F.array_union(worded, few("slots"))))
    chosen = merged.select(
        *key, "item_id", F.size("slots").alias("n_windows"), F.when(template, F.size("loose")).otherwise(F.size("sure")).alias("n_matched"),
        F.when(template, F.col("all_values")).otherwise(F.col("sure_values")).alias("values"),
    ).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    fields = ["n_windows", "n_matched", "coverage"]
    best = chosen.filter(F.col("coverage") >= COVERAGE).groupBy(*key, "item_id").agg(F.max(F.struct("coverage", "n_matched", "n_windows", "values")).alias("b"))
    return best.select(*key, "item_id", *[f"b.{f}" for f in fields[:2]], F.col("b.values.n").alias("n_slots"), F.col("b.values.own").alias("verbatim"), "b.coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, as they came."""
    held_id, held_hash = free_name(docs, "held_id"), free_name(docs, "held_hash")
    held = contaminated(docs, benchmark).select(F.col("doc_id").alias(held_id), F.col("text_hash").alias(held_hash)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(held_id)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(held_hash))
    return docs.join(held, same, "left_anti")
