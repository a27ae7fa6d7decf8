"""Toxicity scores from a bidirectional gated recurrent network.

Words enter as a hashed word vector and the mean of their hashed character
three- and four-grams. A recurrent network reads words in both directions;
attention pools the states of a window of 32 words to one logit. A text's score
is that of its most toxic window, over all overlapping windows of the whole text,
one starting at each word (a text of up to 32 words is one window).

Neighbouring windows share the recurrence: it starts afresh at every 24th word
and runs on for 32, and a word's state is taken where at least 8 words were read
before it, in that direction, or all to the text's end. What attention needs is
then two numbers a word, whose sums slide over the text.

Training is numpy on the driver, on a documented bounded sample of labelled rows:
``SAMPLE`` of each label, by hash, one text an id, whole up to ``PIECE_CHARS`` x
``PIECES`` letters and that many pieces by hash beyond. A logistic fit with the
label's true share turns logits into probabilities. Scoring is a scan of all rows
and whole texts without a shuffle.

Null texts are empty and score as one empty window. Null ids are in the fold of
the empty text and are scored. Repeated rows are scored each. Without labels of
both kinds every score is the share of label 1, or zero without any. Other
columns are never inputs.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import fold, free_name, labelled, text_or_empty, with_scores

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 10
WORD_ROWS, CHAR_ROWS = 4096, 8192
SAMPLE = 2500
#: Letters that a sampled text brings to the driver at most: pieces of so many.
PIECE_CHARS, PIECES = 4096, 16
#: Epochs, but as many as make ``STEPS`` steps on small samples.
EPOCHS, STEPS, BATCH, RATE = 5, 400, 64, 0.015
THRESHOLD = 0.3
SEED = 11
#: Words and windows handled at once, and words whose inputs a task keeps (some
#: 300 bytes each).
BLOCK_WORDS, BLOCK_WINDOWS, CACHE = 100_000, 2048, 150_000
_SPACE = bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters to lower case; punctuation and white space to blanks.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _SPACE, bytes(range(97, 123)) + b" " * len(_SPACE))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, character rows one after another, and where each word's begin."""
    joined = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(joined))  # letters up to the word's end
    mixed, rows, owners = joined, [], []
    hashes = {1: joined}
    for n in (2, 3, 4):
        mixed = mixed[:-1] * np.uint64(0x100000001B3) + joined[n - 1 :] if len(mixed) > 1 else mixed[:0]
        hashes[n] = mixed
    owner = np.repeat(np.arange(len(words)), lengths)
    for n in (3, 4):
        there = left[: len(hashes[n])] >= n
        rows.append((hashes[n][there] ^ (hashes[n][there] >> np.uint64(17))) % np.uint64(CHAR_ROWS))
        owners.append(owner[: len(hashes[n])][there])
    owner_all, row_all = np.concatenate(owners), np.concatenate(rows).astype(np.int64)
    order = np.argsort(owner_all, kind="stable")
    begins = np.searchsorted(owner_all[order], np.arange(len(words)))
    # A word's own row mixes all its letters by their place in it.
    place = (np.arange(len(joined)) - np.repeat(starts, lengths)).astype(np.uint64)
    whole = np.add.reduceat((joined + np.uint64(1)) * (place * place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x85EBCA6B)), starts) if len(words) else joined
    return ((whole ^ (whole >> np.uint64(29))) % np.uint64(WORD_ROWS)).astype(np.int64), row_all[order], begins


@dataclass
class Network:
    word: np.ndarray  # WORD_ROWS x WORD_DIM
    char: np.ndarray  # CHAR_ROWS x CHAR_DIM
    inputs: np.ndarray  # 2 x 3H x (WORD_DIM + CHAR_DIM)
    bias: np.ndarray  # 2 x 3H x 1
    recurrent: np.ndarray  # 2 x 3H x H
    attention: np.ndarray  # 2 x H x 1 x 1
    output: np.ndarray  # 2 x H x 1
    offset: np.ndarray  # 1
    calibration: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    @classmethod
    def fresh(cls, random: np.random.Generator) -> Network:
        normal = lambda scale, *shape: random.normal(0, scale, shape).astype(np.float32)
        dim, gates = WORD_DIM + CHAR_DIM, 3 * HIDDEN
        return cls(normal(0.1, WORD_ROWS, WORD_DIM), normal(0.3, CHAR_ROWS, CHAR_DIM), normal(dim**-0.5, 2, gates, dim), np.zeros((2, gates, 1), np.float32), normal(HIDDEN**-0.5, 2, gates, HIDDEN), normal(0.3, 2, HIDDEN, 1, 1), normal(0.3, 2, HIDDEN, 1), np.zeros(1, np.float32))

    def word_vectors(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Inputs of words, one row each, from ``features_of`` them."""
        own, rows, begins = features
        sums = np.add.reduceat(self.char[rows], begins) if len(own) else np.zeros((0, CHAR_DIM), np.float32)
        sizes = np.diff(np.append(begins, len(rows)))[:, None]
        return np.hstack([self.word[own], (sums / np.maximum(sizes, 1)).astype(np.float32)])

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions, one row per word;
        row 0 is padding."""
        flat = vectors @ self.inputs.reshape(-1, vectors.shape[1]).T
        return np.vstack([np.zeros((1, flat.shape[1]), np.float32), flat]).astype(np.float32)

    def read(self, gates: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions at each position: 2 x H x WINDOW x windows.

        The second direction reads from the end; both advance in one product.
        """
        h, n, half = np.zeros((2, HIDDEN, len(windows)), np.float32), HIDDEN, 3 * HIDDEN
        states = np.empty((2, HIDDEN, WINDOW, len(windows)), np.float32)
        for t in range(WINDOW):
            x = np.stack([gates[windows[:, t], :half].T, gates[windows[:, WINDOW - 1 - t], half:].T]) + self.bias
            g = np.matmul(self.recurrent, h)
            rz = x[:, : 2 * n] + g[:, : 2 * n]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[:, :n], rz[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((h, r, z, new, g[:, 2 * n :]))
            h = new + z * (h - new)
            states[0, :, t], states[1, :, WINDOW - 1 - t] = h[0], h[1]
        return states

    def pool(self, states: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, pooled states and logits."""
        energy = (self.attention * states).sum(axis=(0, 1))
        energy = np.where((windows.T > 0) | (windows.T[:1] == 0), energy, -1e9)  # padding counts only in empty windows
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight).sum(axis=2)
        return weight, pooled, (self.output * pooled).sum(axis=(0, 1)) + self.offset[0]

    def signals(self, states: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray]:
        """A direction's share of each state's energy and output: WINDOW x windows."""
        return (self.attention[direction] * states[direction]).sum(axis=0), (self.output[direction, :, :, None] * states[direction]).sum(axis=0)

    def sliding(self, gates: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all overlapping windows of texts given as word numbers, where
        each begins, and where each text's logits begin."""
        # An empty text is one word of padding.
        begins = np.concatenate([[0], np.cumsum(counts)])
        counts_now = np.maximum(counts, 1)
        if (counts == 0).any():
            numbers = np.insert(numbers, begins[:-1][counts == 0], 0)
            begins = np.concatenate([[0], np.cumsum(counts_now)])
        windows, first = windows_of(numbers, counts_now)
        n_windows = np.diff(first)
        nth = np.arange(first[-1]) - np.repeat(first[:-1], n_windows)
        last = nth == np.repeat(n_windows, n_windows) - 1
        starts = np.repeat(begins[:-1], n_windows) + nth * STRIDE
        ends = np.repeat(begins[1:], n_windows)
        energy, output = np.zeros(begins[-1]), np.full(begins[-1], float(self.offset[0]))
        place = np.arange(WINDOW)[:, None]
        for at in range(0, len(windows), BLOCK_WINDOWS):
            part = slice(at, at + BLOCK_WINDOWS)
            states = self.read(gates, windows[part])
            there = starts[part] + place
            inside = there < ends[part]
            for direction, taken in ((0, (place >= WINDOW - STRIDE) | (nth[part] == 0)), (1, (place < STRIDE) | last[part])):
                e, o = self.signals(states, direction)
                chosen = inside & taken
                energy[there[chosen]] += e[chosen]
                output[there[chosen]] += o[chosen]
        weight = np.exp(energy)
        sums, size = (weight * output, weight), 1
        while size < WINDOW:  # sums over twice as many words each time
            sums = tuple(np.concatenate([s[:-size] + s[size:], s[len(s) - size :]]) if len(s) > size else s for s in sums)
            size *= 2
        per_text = np.maximum(counts_now - WINDOW, 0) + 1
        first = np.concatenate([[0], np.cumsum(per_text)])
        at = np.repeat(begins[:-1], per_text) + np.arange(first[-1]) - np.repeat(first[:-1], per_text)
        found = sums[0][at] / sums[1][at]
        # Short texts are one window of all their words.
        short = np.flatnonzero(counts_now < WINDOW)
        whole = [np.add.reduceat(x, begins[:-1]) for x in (weight * output, weight)]
        found[first[short]] = whole[0][short] / whole[1][short]
        return found, at, first

    def probability(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))


def windows_of(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network reads: every ``STRIDE`` words the next ``WINDOW`` of texts
    given as word numbers (from 1; 0 pads), and where each text's begin. Every
    text has at least one."""
    per_text = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    begins = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], per_text)
    inside = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    at = np.minimum(np.repeat(begins[:-1], per_text)[:, None] + inside, max(len(numbers) - 1, 0))
    taken = numbers[at] if len(numbers) else np.zeros_like(at)
    return np.where(inside < np.repeat(counts, per_text)[:, None], taken, 0), first


class Scorer:
    """Scores texts in blocks; keeps the inputs of words met before."""

    def __init__(self, network: Network):
        self.network = network
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict()
        self.index.default_factory = lambda: len(self.index) + 1
        self.gates = np.zeros((4096, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.network.constant is not None:
            return np.full(len(texts), self.network.constant)
        scores, block, size = [], [], 0
        for text in texts:
            block.append(words_of(text))
            size += len(block[-1])
            if size >= BLOCK_WORDS:
                scores.append(self._block(block))
                block, size = [], 0
        return np.concatenate([*scores, self._block(block)]) if block or not scores else np.concatenate(scores)

    def _block(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.index) > CACHE:
            self._clear()
        known, before = self.index.__getitem__, len(self.index)
        counts = np.array([len(t) for t in texts], np.int64)
        numbers = np.fromiter((n for t in texts for n in map(known, t)), np.int64, int(counts.sum()))
        if len(self.index) > before:
            new = list(islice(self.index, before, None))
            while len(self.gates) <= len(self.index):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[before + 1 : len(self.index) + 1] = self.network.gates(self.network.word_vectors(features_of(new)))[1:]
        if not texts:
            return np.zeros(0)
        logits, _, first = self.network.sliding(self.gates, numbers, counts)
        return self.network.probability(np.maximum.reduceat(logits, first[:-1]))


def _backward(net: Network, steps: list, states, windows, weight, pooled, slope) -> tuple[dict, np.ndarray]:
    """Gradients of the shared weights, and of the gates of each position."""
    n = HIDDEN
    grads = {"output": (pooled * slope).sum(axis=2, keepdims=True), "offset": slope.sum(keepdims=True)}
    d_pooled = net.output * slope
    d_weight = (states * d_pooled[:, :, None]).sum(axis=(0, 1))
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["attention"] = (states * d_energy).sum(axis=(2, 3))[:, :, None, None]
    d_states = weight * d_pooled[:, :, None] + net.attention * d_energy
    d_h, d_recurrent = np.zeros_like(steps[0][0]), np.zeros_like(net.recurrent)
    d_gates = np.empty((WINDOW, 2, 3 * n, len(windows)), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        h, r, z, new, inner = steps[t]
        d_h = d_h + np.stack([d_states[0, :, t], d_states[1, :, WINDOW - 1 - t]])
        d_new = d_h * (1 - z) * (1 - new * new)
        pre = np.concatenate([d_new * inner * r * (1 - r), d_h * (h - new) * z * (1 - z), d_new * r], axis=1)
        d_recurrent += np.matmul(pre, h.transpose(0, 2, 1))
        d_gates[t] = pre
        d_gates[t][:, 2 * n :] = d_new
        d_h = d_h * z + np.matmul(net.recurrent.transpose(0, 2, 1), pre)
    grads["recurrent"] = d_recurrent
    grads["bias"] = d_gates.sum(axis=(0, 3))[:, :, None]
    return grads, d_gates


class _Adam:
    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.names = ("word", "char", "inputs", "bias", "recurrent", "attention", "output", "offset")
        self.first = {n: np.zeros_like(getattr(net, n)) for n in self.names}
        self.second = {n: np.zeros_like(getattr(net, n)) for n in self.names}

    def apply(self, grads: dict, rate: float) -> None:
        self.step += 1
        for name in self.names:
            value, g = getattr(self.net, name), grads[name].reshape(getattr(self.net, name).shape)
            self.first[name] += 0.1 * (g - self.first[name])
            self.second[name] += 0.01 * (g * g - self.second[name])
            m, v = self.first[name] / (1 - 0.9**self.step), self.second[name] / (1 - 0.99**self.step)
            value -= rate * m / (np.sqrt(v) + 1e-6)


def train(texts: list[str], labels: np.ndarray, share: float) -> Network:
    """Fit on texts, several windows a text.

    Each epoch first reads all windows, then learns from each text's top window,
    which carries the text's label, and from a random one of the clean texts.
    """
    random = np.random.default_rng(SEED)
    net = Network.fresh(random)
    index: dict[bytes, int] = defaultdict()
    index.default_factory = lambda: len(index) + 1
    words, counts = [], []
    for text in texts:
        found = words_of(text)
        counts.append(len(found))
        words.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
    numbers, counts = np.concatenate(words), np.array(counts)
    vocabulary = list(index)
    blocks = [features_of(vocabulary[i : i + 20_000]) for i in range(0, len(vocabulary), 20_000)]
    features = [(own.astype(np.int32), rows.astype(np.int32), begins) for own, rows, begins in blocks]
    optimiser, labels = _Adam(net), labels.astype(np.float32)
    begins = np.concatenate([[0], np.cumsum(counts)])
    epochs = max(EPOCHS, -(-STEPS // -(-int(len(labels) + (labels == 0).sum()) // BATCH)))

    def windows_at(starts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Windows of the owners' words from these places on, padded."""
        there = starts[:, None] + np.arange(WINDOW)
        return np.where(there < begins[owners + 1][:, None], numbers[np.minimum(there, max(len(numbers) - 1, 0))] if len(numbers) else 0, 0)

    everyone = np.arange(len(counts))
    owners = np.concatenate([everyone, everyone[labels == 0]])
    goals = np.concatenate([labels, labels[labels == 0]])
    for epoch in range(epochs):
        drawn = begins[:-1] + (random.random(len(counts)) * (np.maximum(counts - WINDOW, 0) + 1)).astype(int)
        top = _top(net, features, numbers, counts)[1] if epoch else drawn
        picks = np.concatenate([top, drawn[labels == 0]])
        order = random.permutation(len(picks))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            _learn(net, optimiser, vocabulary, windows_at(picks[batch], owners[batch]), goals[batch], random, RATE * (1 - epoch / epochs) + 1e-4)
    net.calibration = calibrated(_top(net, features, numbers, counts)[0], labels, share)
    return net


def _top(net: Network, features: list[tuple], numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's greatest logit and where among all words its window begins."""
    gates, begins = np.zeros((1 + sum(len(block[0]) for block in features), 6 * HIDDEN), np.float32), np.concatenate([[0], np.cumsum(counts)])
    filled = 1
    for block in features:
        gates[filled : filled + len(block[0])] = net.gates(net.word_vectors(block))[1:]
        filled += len(block[0])
    best, at, text = [], [], 0
    while text < len(counts):  # some texts at a time
        until = max(text + 1, int(np.searchsorted(begins, begins[text] + BLOCK_WORDS, side="right")) - 1)
        some = counts[text:until]
        logits, _, first = net.sliding(gates, numbers[begins[text] : begins[until]], some)
        top = np.maximum.reduceat(logits, first[:-1])
        hits = np.flatnonzero(logits == np.repeat(top, np.diff(first)))
        best.append(top)
        at.append(begins[text:until] + hits[np.searchsorted(hits, first[:-1])] - first[:-1])
        text = until
    return np.concatenate(best), np.concatenate(at)


def _learn(net, optimiser, vocabulary, windows, goals, random, rate) -> None:
    """One step on a batch of windows."""
    used, numbered = np.unique(windows, return_inverse=True)
    windows = numbered.reshape(-1, WINDOW) + (0 if used[0] == 0 else 1)
    own, rows, begins = features_of([vocabulary[k - 1] for k in used if k])
    sizes = np.diff(np.append(begins, len(rows)))
    # Half of the words are read by their characters alone.
    shown = (random.random((len(own), 1)) < 0.5).astype(np.float32)
    chars = np.add.reduceat(net.char[rows], begins) / np.maximum(sizes, 1)[:, None] if len(own) else np.zeros((0, CHAR_DIM))
    vectors = np.hstack([net.word[own] * shown, chars]).astype(np.float32)
    gates, half = net.gates(vectors), 3 * HIDDEN
    steps: list = []
    states = net.read(gates, windows, steps)
    weight, pooled, found = net.pool(states, windows)
    slope = (1 / (1 + np.exp(-np.clip(found, -30, 30))) - goals).astype(np.float32) / len(goals)
    grads, d_gates = _backward(net, steps, states, windows, weight, pooled, slope)
    # Gradients of the words' gate rows, forward half and backward half.
    d_rows = np.zeros_like(gates)
    np.add.at(d_rows[:, :half], windows.T.ravel(), d_gates[:, 0].transpose(0, 2, 1).reshape(-1, half))
    np.add.at(d_rows[:, half:], windows.T[::-1].ravel(), d_gates[:, 1].transpose(0, 2, 1).reshape(-1, half))
    d_rows = d_rows[1:]
    grads["inputs"] = d_rows.T @ vectors + 1e-4 * net.inputs.reshape(2 * half, -1)
    d_vectors = d_rows @ net.inputs.reshape(2 * half, -1)
    grads["word"], grads["char"] = 1e-5 * net.word, 1e-5 * net.char
    np.add.at(grads["word"], own, d_vectors[:, :WORD_DIM] * shown)
    np.add.at(grads["char"], rows, np.repeat(d_vectors[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
    optimiser.apply(grads, rate)


def calibrated(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with each label at its true share."""
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    goal = np.clip(labels, 0.01, 0.99)
    centre, spread = float(logits.mean()), float(logits.std()) or 1.0
    theta, x = np.array([1.0, 0.0]), np.column_stack([(logits - centre) / spread, np.ones(len(logits))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - goal)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta - step * min(1.0, 0.5 / max(float(np.abs(step).max()), 1e-9))
    scale = max(float(theta[0]), 0.05) / spread
    return scale, float(theta[1]) - scale * centre


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 4, held_fold: int = 2) -> Network:
    """Train on at most ``SAMPLE`` rows of each label outside the held-out fold."""
    marked = labelled(labels, target).filter(fold(F.col("doc_id"), folds) != held_fold)
    tally = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    share = tally["ones"] / tally["n"] if tally["n"] else 0.0
    sample = None
    for label in (0, 1):
        some = marked.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        sample = some if sample is None else sample.unionByName(some)
    # At most 2 * SAMPLE ids: the bound that makes this broadcast safe.
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    n_pieces = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE_CHARS).cast("int")
    some = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), n_pieces), lambda i: F.struct(F.xxhash64("doc_id", i).alias("by"), i.alias("i")))), 1, PIECES)
    pieces = F.transform(F.array_sort(F.transform(some, lambda p: p["i"])), lambda i: F.substring("text", i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))
    short = F.when(n_pieces < PIECES, F.col("text")).otherwise(F.array_join(pieces, " "))
    # One text an id, that of the least hash, however many rows have it.
    texts = named.select("doc_id", "label", F.struct(F.xxhash64("text").alias("by"), short.alias("text")).alias("t")).groupBy("doc_id", "label").agg(F.min("t").alias("t"))
    rows = sorted(((r["doc_id"], r["label"], r["text"]) for r in texts.select("doc_id", "label", "t.text").toLocalIterator()))
    found = np.array([r[1] for r in rows])
    if len(rows) < 2 or found.min() == found.max():
        net = Network.fresh(np.random.default_rng(SEED))
        net.constant = share
        return net
    return train([r[2] for r in rows], found, share)


def scores(docs: DataFrame, network: Network, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "score", lambda: Scorer(network))
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, network: Network) -> DataFrame:
    """The documents that are not predicted toxic, as they came. No shuffle."""
    name = free_name(docs, "toxicity_score")
    return with_scores(docs, "text", name, lambda: Scorer(network)).filter(F.col(name) < THRESHOLD).select(*docs.columns)
