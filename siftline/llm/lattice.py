"""Language-model scores from a lattice of all segmentations.

A document is a sequence of words and one end. Seen words have a discounted
unigram score; the discount's mass goes to the subword model, so that every word
has the probability

    (max(c - d, 0) + d * types * L(word)) / N

where L sums over all segmentations of the word into the pieces of a public
vocabulary. The seen word is one more path of that lattice, and so is a word that
repeats: within a document, k earlier uses among i words give it the probability
(k + K * p) / (i + K), and the same once more behind the word before it. A
document's marginal also sums over the weights ``REPEATS`` of these paths, each
as likely beforehand; one of them is never to repeat.

A text is also cut into phrases, each up to a word whose hash says so, ``PHRASE``
words or the end. Phrases seen in training are discounted in the same way, and
the discount's mass goes to the phrase spelled out in words: one more level of
the lattice, which carries passages that documents share. Phrases are told apart
by 64 bits of their words' hashes. Piece scores start
from the vocabulary's own order and are refined by expectation maximisation over
all distinct training words. Letters without a piece cost their bytes. Summed
over all words the probabilities are at most one.

A training text is scored by what the other rows teach: its own words and phrases
are taken out of the counts, totals and types first, so that its score is comparable
to a held-out text's. (Discounts and piece scores are kept; they are a few numbers
and one table for the whole corpus.) ``lattice_score`` is the plain lattice of seen
words and subwords, without repeats and phrases.

Texts are read once. Each partition becomes chunks: the distinct words with
their training counts, the same of phrases, and the texts as numbers of both.
Only distinct words and phrases per chunk are shuffled; counts come back to the chunk they are needed in.
No table of words is ever broadcast or collected.

Null texts are empty and hold the end alone. Null ids are in the fold of the
empty text. Repeated rows count and are scored each. Without training words every
word has half its subword score and the end one half. Probabilities stay in logs
throughout: a long unseen word costs what its pieces cost. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siftline.llm.storage import fold, stored, text_or_empty

#: Text bytes of a chunk, and the longest piece used.
CHUNK_BYTES = 32_000_000
LONGEST = 16
ROUNDS = 2
#: Weights K of a word's score against its repeats, alone and behind a word
#: (None: there only the repeats alone count).
REPEATS = [(k, behind) for k in (300.0, 1000.0, 3000.0, 10000.0) for behind in (None, 2.0, 10.0, 50.0)]
#: Tokens of texts handled at once; a longer text is handled alone.
BLOCK_TOKENS = 500_000
#: Most words of a phrase, and the share of words (one in so many) that end one.
PHRASE, ENDING = 16, 8
#: Size of the bit table that is asked before a piece is searched for.
SLOT_BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK_SCHEMA = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<binary>, counts array<long>, spans binary, sizes binary, phrases array<long>, uses array<long>"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file and first scores from their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(s(i) for s in special)]
    pieces = [p for p in pieces if len(p) <= LONGEST]
    weight = 1.0 / (np.arange(len(pieces) + 1) + 100.0)  # the last one stands for bytes
    return pieces, np.log(weight / weight.sum())


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - SLOT_BITS)


class Lattice:
    """Forward and backward recursions in log space over batches of words."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        self.scores = np.append(scores, -np.inf)  # the last entry: no such piece
        self.bytes, self.none = len(pieces), len(pieces) + 1
        by_length = defaultdict(list)
        for k, piece in enumerate(pieces):
            by_length[len(piece)].append((k, piece))
        self.tables = {}
        for n, group in by_length.items():
            codes = np.array([[ord(c) for c in p] for _, p in group], np.uint64)
            keys = codes[:, 0]
            for j in range(1, n):
                keys = keys * _MIX + codes[:, j]
            order = np.argsort(keys)
            slots = np.zeros(1 << SLOT_BITS, bool)
            slots[slot_of(keys)] = True
            self.tables[n] = (keys[order], np.array([k for k, _ in group])[order], slots)

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the piece at each position, ``none`` where there is none."""
        found, keys, n = [], codes, codes.shape[1]
        for length in range(1, min(LONGEST, n) + 1):
            if length > 1:
                keys = keys[:, :-1] * _MIX + codes[:, length - 1 :]
            if length not in self.tables:
                found.append(np.full(keys.shape, self.none))
                continue
            known, ids, slots = self.tables[length]
            # Few stretches share a piece's slot; only those are searched for.
            likely = np.flatnonzero(slots[slot_of(keys.ravel())])
            sought = keys.ravel()[likely]
            at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
            pieces = np.full(keys.size, self.none)
            pieces[likely] = np.where(known[at] == sought, ids[at], self.none)
            found.append(pieces.reshape(keys.shape))
        found[0] = np.where(found[0] == self.none, self.bytes, found[0])
        return found

    def weights(self, codes: np.ndarray, arcs: list[np.ndarray]) -> list[np.ndarray]:
        scored = [self.scores[a] for a in arcs]
        size = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        scored[0] = np.where(arcs[0] == self.bytes, size * (self.scores[self.bytes] - np.log(256)), scored[0])
        return scored

    @staticmethod
    def forward(scored: list[np.ndarray]) -> np.ndarray:
        rows, n = scored[0].shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            paths = np.stack([alpha[j - k] + scored[k - 1][:, j - k] for k in range(1, min(len(scored), j) + 1)])
            top = paths.max(axis=0)
            alpha[j] = top + np.log(np.exp(paths - top).sum(axis=0))
        return alpha

    @staticmethod
    def backward(scored: list[np.ndarray]) -> np.ndarray:
        rows, n = scored[0].shape
        beta = np.full((n + 1, rows), -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            paths = np.stack([beta[i + k] + scored[k - 1][:, i] for k in range(1, min(len(scored), n - i) + 1)])
            top = paths.max(axis=0)
            beta[i] = top + np.log(np.exp(paths - top).sum(axis=0))
        return beta

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        result = np.zeros(len(words))
        for rows, codes in batches_of(words):
            result[rows] = self.forward(self.weights(codes, self.arcs(codes)))[-1]
        return result

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece (and of bytes) in the words, each once."""
        total = np.zeros(self.none + 1)
        for _, codes in batches_of(words):
            arcs = self.arcs(codes)
            scored = self.weights(codes, arcs)
            alpha, beta = self.forward(scored), self.backward(scored)
            for k, (pieces, s) in enumerate(zip(arcs, scored), start=1):
                row, at = np.nonzero(pieces != self.none)
                share = np.exp(alpha[at, row] + s[row, at] + beta[at + k, row] - alpha[-1, row])
                total += np.bincount(pieces[row, at], share, len(total))
        return total[: self.none]


def batches_of(words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of equal length together, as code points after the word-begin mark."""
    by_length = defaultdict(list)
    for k, word in enumerate(words):
        text = "▁" + word.decode("utf-8", "replace")
        by_length[len(text)].append((k, text))
    for n, group in by_length.items():
        step = max(1, 200_000 // n)
        for start in range(0, len(group), step):
            part = group[start : start + step]
            joined = "".join(t for _, t in part).encode("utf-32-le")
            yield [k for k, _ in part], np.frombuffer(joined, np.uint32).reshape(-1, n).astype(np.uint64)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how often its key came before, and a number of its key."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(first) - 1
    earlier, number = np.empty((2, len(keys)), np.int64)
    earlier[order] = np.arange(len(keys)) - np.flatnonzero(first)[group]
    number[order] = group
    return earlier, number


def with_ends(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    return np.insert(tokens.astype(np.int64), np.cumsum(lengths), end)


def phrases_of(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of the phrases of texts, which hold their ends."""
    hashed = hashes[tokens]
    last = hashed % np.uint64(ENDING) == 0
    last[np.cumsum(lengths) - 1] = True
    stops = np.flatnonzero(last) + 1
    runs = np.diff(stops, prepend=0)
    parts = -(-runs // PHRASE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(np.repeat(runs, parts) - nth * PHRASE, PHRASE)
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(PHRASE, _MIX))
    mixed = np.add.reduceat(hashed * powers[np.arange(len(tokens)) - np.repeat(starts, sizes)], starts)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64), sizes


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log10 of the sum of two probabilities; ``a`` may be zero."""
    return np.maximum(a, b) + np.log10(1 + 10.0 ** -np.abs(a - b))


def repeated(uses: np.ndarray, among: np.ndarray, weight: float, p: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(uses + weight * p) / (among + weight)`` and its log10, however small p is."""
    share = (uses + weight * p) / (among + weight)
    small = np.flatnonzero(share < 1e-290)  # below any use: p alone
    result = np.log10(np.maximum(share, 1e-290))
    result[small] = logs[small] + np.log10(weight / (among[small] + weight))
    return share, result


def uses_in(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how often its owner uses its key, and whether it is the first use."""
    earlier, number = ranked(owner * (int(keys.max(initial=0)) + 1) + keys)
    return np.bincount(number, minlength=1)[number], earlier == 0


class Counts:
    """Counts of words or phrases as each text is to see them.

    ``owner`` numbers the text of each place, ``keys`` what stands there, ``c`` its
    uses in training. A text that ``learnt`` marks is left out of its own counts.
    """

    def __init__(self, owner: np.ndarray, keys: np.ndarray, c: np.ndarray, learnt: np.ndarray, total: int, types: int):
        own, first = uses_in(owner, keys)
        own, texts = np.where(learnt[owner], own, 0), len(learnt)
        self.c = c - own
        self.total = total - np.where(learnt, np.bincount(owner, minlength=texts), 0)
        gone = first & (own > 0) & (self.c == 0)
        self.types = types - np.bincount(owner[gone], minlength=texts)
        self.owner = owner

    def whole(self, discount: float) -> np.ndarray:
        """Log10 of the discounted share of each place, minus infinity where it is new."""
        known = self.c > 0
        share = np.full(len(known), -np.inf)
        share[known] = np.log10((self.c[known] - discount) / self.total[self.owner[known]])
        return share

    def spare(self, discount: float, empty: float) -> np.ndarray:
        """Log10 of what discounts leave in each text's view; ``empty`` without counts."""
        left = np.full(len(self.types), np.log10(empty))
        some = self.types > 0
        left[some] = np.log10(discount * self.types[some] / self.total[some])
        return left


def text_scores(
    tokens: np.ndarray, lengths: np.ndarray, logs: np.ndarray, sizes: np.ndarray, copied: np.ndarray, spelled: float | np.ndarray, each: np.ndarray | None = None
) -> np.ndarray:
    """Log10 probability of each text, its end included, over all paths.

    ``logs`` holds the scores of the words that ``tokens`` number (``each``, if given,
    the score at each place instead), ``sizes`` and ``copied`` the words of each phrase
    and its score as a whole, ``spelled`` that of spelling a phrase out.
    """
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(tokens)) - starts[text]
    each = logs[tokens] if each is None else each
    alone = (10.0**each, each)
    used, _ = ranked(text * len(logs) + tokens)
    before = np.where(place > 0, tokens[np.arange(len(tokens)) - 1], len(logs))
    behind, context = ranked(text * (len(logs) + 1) + before)
    again, _ = ranked(context * len(logs) + tokens)
    phrase = np.cumsum(sizes) - sizes
    first = np.searchsorted(phrase, starts)

    def total(scores: np.ndarray) -> np.ndarray:
        return np.add.reduceat(either(copied, spelled + np.add.reduceat(scores, phrase)), first)

    paths = [total(alone[1])]
    for weight, second in REPEATS:
        if second is None:
            once = repeated(used, place, weight, *alone)
        paths.append(total((once if second is None else repeated(again, behind, second, *once))[1]))
    top = np.max(paths, axis=0)
    return top + np.log10(np.mean(10.0 ** (np.array(paths) - top), axis=0))


def blocks_of(lengths: np.ndarray) -> Iterator[slice]:
    """Runs of texts of at most ``BLOCK_TOKENS`` tokens, or of one text."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start] - lengths[start]
        stop = max(int(np.searchsorted(ends, base + BLOCK_TOKENS, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


def chunk_table(docs: DataFrame, held_out: Column) -> DataFrame:
    """The texts as numbers of the chunk's distinct words (stored)."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from xxhash import xxh64_intdigest

        longs = pa.list_(pa.int64())
        schema = pa.schema([("chunk", pa.int64()), ("ids", longs), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", longs), ("spans", pa.binary()), ("sizes", pa.binary()), ("phrases", longs), ("uses", longs)])
        number = TaskContext.get().partitionId() << 32

        def fresh():
            index: dict[bytes, int] = defaultdict()
            index.default_factory = index.__len__
            return index, [], [], [], [], 0

        def row():
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            training = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[training], minlength=len(index))
            hashes = np.array([xxh64_intdigest(w) for w in index] + [0], np.uint64)
            n, out, ends = np.array(lengths), np.array(held, bool), np.cumsum(lengths)
            hashed, sizes, learnt = [], [], []
            for part in blocks_of(n + 1):
                texts = with_ends(tokens[ends[part.start] - n[part.start] : ends[part.stop - 1]], n[part], len(index))
                found, words_in = phrases_of(texts, n[part] + 1, hashes)
                owner = np.searchsorted(np.cumsum(n[part] + 1), np.cumsum(words_in))
                hashed.append(found)
                sizes.append(words_in.astype(np.uint8))
                learnt.append(~out[part][owner])
            phrases, spans = np.unique(np.concatenate(hashed), return_inverse=True)
            uses = np.bincount(spans[np.concatenate(learnt)], minlength=len(phrases))
            packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b"" for x in (tokens, spans.astype(np.int32), np.concatenate(sizes))]
            values = (number, ids, held, lengths, packed[0], list(index), counts, packed[1], packed[2], phrases, uses)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        index, ids, held, lengths, parts, size = fresh()
        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield row()
                    number += 1
                    index, ids, held, lengths, parts, size = fresh()
                words = raw.lower().split()
                parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                held.append(out)
                lengths.append(len(words))
                size += len(raw)
        if ids:
            yield row()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), text_or_empty().alias("text"))
    return stored(chosen.mapInArrow(encode, CHUNK_SCHEMA), compression="zstd")


def piece_scores(words: DataFrame, path: str) -> np.ndarray:
    """Piece scores after ``ROUNDS`` rounds over all distinct training words.

    What comes to the driver has the vocabulary file's size, whatever the corpus.
    """
    pieces, scores = vocabulary(path)
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast(scores)

        def uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(vocabulary(path)[0], shared.value), None
            for batch in batches:
                found = lattice.expected(batch.column(0).to_pylist())
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["piece", "uses"])

        total = np.full(len(scores), 0.01)
        for r in words.select("word").mapInArrow(uses, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            total[r["piece"]] += r["uses"]
        scores = np.log(total / total.sum())
    return scores


def tally(counted: DataFrame) -> tuple[Row, float]:
    """Uses and types in training, and the discount from types used once or twice."""
    c = F.col("c")
    t = counted.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.count_if(c > 0).alias("types"), F.count_if(c == 1).alias("once"), F.count_if(c == 2).alias("twice")).first()
    return t, min(max(t["once"] / (t["once"] + 2 * t["twice"]), 0.1), 0.9) if t["once"] else 0.1


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """Numbers of a compressed binary cell."""
    raw = column[0].as_py()
    return np.frombuffer(zstandard.decompress(raw), kind) if raw else np.zeros(0, kind)


def score_texts(docs: DataFrame, path: str, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score``."""
    spark = docs.sparkSession
    chunks = chunk_table(docs, held_out)
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("chunk", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = stored(places.groupBy("word").agg(F.sum("n").alias("c")))
    t, discount = tally(words)
    ends = chunks.select(F.explode("held").alias("h")).agg(F.count_if(~F.col("h"))).first()[0]
    total = t["n"] + ends
    types = t["types"] + (1 if ends else 0)
    spans = chunks.select("chunk", F.posexplode(F.arrays_zip("phrases", "uses")).alias("pos", "p")).select("chunk", "pos", F.col("p.phrases").alias("phrase"), F.col("p.uses").alias("n"))
    # Sums come back to each chunk's row in the one shuffle that forms them.
    same = Window.partitionBy("phrase")
    first = F.row_number().over(same.orderBy("chunk")) == 1
    spans = stored(spans.select("chunk", "pos", F.sum("n").over(same).alias("c"), first.alias("first")))
    p, left = tally(spans.filter("first"))
    shared = spark.sparkContext.broadcast(piece_scores(words.filter("c > 0"), path))
    end_base = float(np.log10((ends + 1) / (total + types + 1)))

    def marginals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path)[0], shared.value)
        for batch in batches:
            logs = lattice.marginals(batch.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], names=["word", "c", "log"])

    scored = words.mapInArrow(marginals, "word binary, c long, log double")
    back = places.select("chunk", "pos", "word").join(scored, "word").select("chunk", "pos", "c", "log")
    # Phrases (without a log) of training alone come back; the others are only spelled out.
    back = back.unionByName(spans.filter("c > 0").select("chunk", "pos", "c", F.lit(None).cast("double").alias("log")))
    n_words, n_types, n_phrases, phrase_types = t["n"], t["types"], p["n"], p["types"]

    def documents(chunk: pa.Table, stats: pa.Table) -> pa.Table:
        column = lambda name: chunk.column(name).combine_chunks()
        lengths = np.array(column("lengths")[0].as_py() or [], dtype=np.int64)
        learnt = ~np.array(column("held")[0].as_py() or [], dtype=bool)
        tokens = unpacked(column("tokens"), np.int32)
        stretches, sizes = unpacked(column("spans"), np.int32), unpacked(column("sizes"), np.uint8).astype(np.int64)
        is_word = stats.column("log").is_valid().to_numpy()
        found = stats.filter(pa.array(~is_word))
        phrase_uses = np.zeros(int(stretches.max(initial=-1)) + 1, np.int64)
        phrase_uses[found.column("pos").to_numpy()] = found.column("c").to_numpy()
        phrase_ends = np.cumsum(sizes)
        stats = stats.filter(pa.array(is_word))
        order = np.argsort(stats.column("pos").to_numpy())
        word_uses, spell = stats.column("c").to_numpy()[order], stats.column("log").to_numpy()[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])

        def sums(values: np.ndarray) -> np.ndarray:
            # Summed per text, so that one text's rounding is not another's.
            padded = np.append(values[tokens].astype(float), 0.0)
            return np.where(lengths > 0, np.add.reduceat(padded, starts[:-1]), 0.0) if len(lengths) else np.zeros(0)

        known, base = sums(word_uses > 0), sums(np.log10((word_uses + 1) / (total + types + 1)))
        score, plain = [np.zeros(0)], [np.zeros(0)]
        for part in blocks_of(lengths + 1):
            n, taught = lengths[part], learnt[part]
            block, texts = tokens[starts[part.start] : starts[part.stop]], np.arange(len(n))
            owner = np.repeat(texts, n)
            seen = Counts(owner, block, word_uses[block], taught, n_words, n_types)
            # Words share the total with the ends; a text left out takes its own end along.
            seen.total = seen.total + ends - taught
            at = either(seen.whole(discount), seen.spare(discount, 0.5)[owner] + spell[block])
            others = np.where(seen.types > 0, (ends - taught) / np.maximum(seen.total, 1), 0.5)
            each = np.insert(at, np.cumsum(n), np.log10(others))
            whole = with_ends(block, n, len(spell))
            a, b = np.searchsorted(phrase_ends, (starts + np.arange(len(starts)))[[part.start, part.stop]], side="right")
            of = np.searchsorted(np.cumsum(n + 1), np.cumsum(sizes[a:b]))
            copies = Counts(of, stretches[a:b], phrase_uses[stretches[a:b]], taught, n_phrases, phrase_types)
            score.append(text_scores(whole, n + 1, np.append(spell, 0.0), sizes[a:b], copies.whole(left), copies.spare(left, 1.0)[of], each))
            plain.append(np.add.reduceat(each, np.cumsum(n + 1) - n - 1))
        return pa.table({
            "doc_id": column("ids").flatten(), "held_out": column("held").flatten(), "n_tokens": lengths + 1,
            "n_known": np.rint(known).astype(np.int64) + (1 if ends else 0), "train_tokens": np.full(len(lengths), total, np.int64),
            "base_score": base + end_base, "score": np.concatenate(score), "lattice_score": np.concatenate(plain),
        })

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    texts = chunks.select(F.col("chunk").alias("of"), "ids", "held", "lengths", "tokens", "spans", "sizes")
    return texts.groupBy("of").cogroup(back.groupBy("chunk")).applyInArrow(documents, fields)


def seventh(doc_id: str = "doc_id") -> Column:
    """The held-out seventh of the contract."""
    return fold(F.col(doc_id), 7) == 2
