"""Quality scores from document statistics.

Statistics of whole texts are mapped by random Fourier features, whose inner
products approximate a Gaussian kernel. Ridge regression is fitted from normal
equations that every partition sums for itself; isotonic regression over a fixed
grid of scores turns the result into probabilities. All labelled rows of the
training folds take part; what reaches the driver has a fixed size.

Null texts are empty. Null ids are in the fold of the empty text and are scored,
but carry no label. Repeated rows are scored each. Without labels of both kinds
every score is the share of label 1, or one half without any. Other columns are
never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import fold, free_name, from_texts, labelled, stored, with_scores

FEATURES = 224
RIDGE = 1e-3
#: Cells of the score grid between -0.5 and 1.5 that calibration counts by.
GRID = 1000
SEED = 7
THRESHOLD = 0.3
#: Byte classes counted in a text.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"?",
    b"|", b"#$%&*", b"<>", b"{}[]()", b";=+", b"/\\", b"@", b"-_", b"'\"`", b":", bytes(range(128, 192)), bytes(range(192, 256)), bytes(range(32)),
)
_MEMBERS = np.array([[b in group for b in range(256)] for group in CLASSES], float)


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; all finite, also for empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    shares = counts / size
    used = shares[shares > 0]
    words, lines = raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    tally, line_tally = Counter(words), Counter(lines)
    pairs = set(zip(words, words[1:]))
    capitals = sum(map(bytes.isupper, words))
    titled = sum(map(bytes.istitle, words))
    alphabetic = sum(map(bytes.isalpha, words))
    more = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(tally) / n, max(tally.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, (len(pairs) + 1) / n,
        len(line_tally) / len(lines), max(line_tally.values()) / len(lines), np.log1p(len(words) / len(lines)),
        capitals / n, titled / n, alphabetic / n, -(used * np.log2(used)).sum(),
        np.log1p(len(words) / (1 + counts[46] + counts[33] + counts[63])), (lengths <= 2).mean(), (lengths >= 12).mean(),
    ]
    return np.concatenate([np.sqrt(_MEMBERS @ shares), more])


WIDTH = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.column_stack([np.ones(len(x)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def _measured(texts: list[str]) -> pa.Array:
    found = np.array([statistics(t) for t in texts]).reshape(-1, WIDTH)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))


def with_statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    """The documents, each with the statistics of its text (stored)."""
    return stored(docs.withColumn(name, from_texts("text", "array<double>", lambda: _measured)))


def statistics_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats)`` of every row (stored)."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(chosen.select("doc_id", from_texts("text", "array<double>", lambda: _measured).alias("stats")))


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["stats"].tolist(), float).reshape(-1, WIDTH)


def _summed(rows: DataFrame, part_of, size: int) -> np.ndarray:
    """Add up a fixed number of sums that ``part_of(batch)`` gives per task."""

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            total += part_of(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "s": total[at]})

    result = np.zeros(size)
    for r in rows.mapInPandas(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        result[r["at"]] = r["s"]
    return result


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing levels closest to ``ones / counts`` (pooled neighbours)."""
    pools: list[list[float]] = []
    for y, n in zip(ones.tolist(), counts.tolist()):
        pools.append([y, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), (y + 0.5) / (n + 1)) for y, n, k in pools])


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_fold: int = 0) -> Model:
    marked = labelled(labels, target).filter(fold(F.col("doc_id"), folds) != held_fold)
    rows = stored(stats.join(marked, "doc_id").select("stats", "label"))

    def moments(batch):
        x = _matrix(batch)
        return np.concatenate([[len(x), batch["label"].sum()], x.sum(0), (x * x).sum(0)])

    sums = _summed(rows, moments, 2 + 2 * WIDTH)
    n, ones = sums[0], sums[1]
    mean = sums[2 : 2 + WIDTH] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[2 + WIDTH :] / max(n, 1) - mean**2, 1e-8))
    random = np.random.default_rng(SEED)
    # The kernel's width: standardised points lie about sqrt(2 * width) apart.
    directions = random.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH)
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    d = FEATURES + 1
    model = Model(mean, scale, directions, phases, np.zeros(d), np.array([-1.0, 2.0]), np.full(2, ones / n if n else 0.5))
    if not 0 < ones < n:
        return model

    def equations(batch):
        z, y = model.expand(_matrix(batch)), batch["label"].to_numpy(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows, equations, d * d + d)
    penalty = RIDGE * n * np.eye(d) / FEATURES
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + penalty, sums[d * d :])

    def cells(batch):
        at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * GRID, 0, GRID - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at, batch["label"], GRID)])

    sums = _summed(rows, cells, 2 * GRID)
    there = np.flatnonzero(sums[:GRID])
    model.knots, model.levels = (there + 0.5) / GRID * 2 - 0.5, isotonic(sums[GRID:][there], sums[:GRID][there])
    return model


def score_of(stats: str, model: Model) -> Column:
    """The score of statistics, a vector at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(batch.flatten().to_numpy().reshape(-1, WIDTH)), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(F.col(stats))


def scores(stats: DataFrame, model: Model, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = stats.select("doc_id", score_of("stats", model).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the threshold, as they came. No shuffle."""

    def scorer():
        return lambda texts: model.score(np.array([statistics(t) for t in texts]).reshape(-1, WIDTH))

    name = free_name(docs, "quality_score")
    return with_scores(docs, "text", name, scorer).filter(F.col(name) >= THRESHOLD).select(*docs.columns)


def fit_and_keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``keep_good`` by a model fitted to the same documents.

    Texts are measured once; the fit and the scores read the stored statistics.
    """
    stats, score = free_name(docs, "stats"), free_name(docs, "quality_score")
    measured = with_statistics(docs, stats)
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stats).alias("stats")), labels)
    return measured.withColumn(score, score_of(stats, model)).filter(F.col(score) >= THRESHOLD).select(*docs.columns)
