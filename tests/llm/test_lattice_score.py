"""The lattice score end to end, against counts worked out anew for every text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from siftline.llm import lattice
from siftline.llm.queries import vocabulary
from siftline.llm.storage import importable

SHARED = "a passage that several documents of this small corpus hold word for word , again and again"
TEXTS = [
    (1, f"The river ran . {SHARED} end"), (2, f"{SHARED} zebra zebra zebra"), (3, f"birds {SHARED} . the river"),
    (4, "only this text says quixotic quixotic words"), (5, None), (6, ""), (7, "the the the river"), (9, f"unseen {SHARED} unseenly"),
    (9, f"unseen {SHARED} unseenly"), (16, "birds 日本語 naïve river"), (17, "birds 日本語 river the"), (None, "no id here"), (12, f"{SHARED} {SHARED}"),
]
END = object()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrases(tokens):
    cut = [[]]
    for w in tokens:
        cut[-1].append(w)
        if w is END or xxhash.xxh64_intdigest(w.encode()) % 8 == 0 or len(cut[-1]) == 16:
            cut.append([])
    return [tuple(c) for c in cut if c]


def discount_of(counts):
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.1


def expected_scores(rows):
    texts = [[*words(t), END] for _, t in rows]
    training = [not held(i) for i, _ in rows]
    taught = Counter(w for t, k in zip(texts, training) if k for w in t)
    plain = Counter({w: c for w, c in taught.items() if w is not END})
    whole = Counter(p for t, k in zip(texts, training) if k for p in phrases(t))
    d, left = discount_of(plain), discount_of(whole)
    path = vocabulary("piece_bpe_32k.model")
    pieces, scores = lattice.vocabulary(path)
    learnt = [w.encode() for w in plain]
    for _ in range(lattice.ROUNDS):
        uses = lattice.Lattice(pieces, scores).expected(learnt) + 0.01 if learnt else np.full(len(scores), 0.01)
        scores = np.log(uses / uses.sum())
    model = lattice.Lattice(pieces, scores)
    spell = {w: math.exp(model.marginals([w.encode()])[0]) for t in texts for w in t if w is not END}
    for t, k in zip(texts, training):
        seen = taught - Counter(t) if k else taught
        copies = whole - Counter(phrases(t)) if k else whole
        total, types = sum(seen.values()), len(seen) - (END in seen)

        def word(w):
            if not types:
                return 0.5 if w is END else 0.5 * spell[w]
            return seen[END] / total if w is END else (max(seen[w] - d, 0) + d * types * spell[w]) / total

        spelled = left * len(copies) / sum(copies.values()) if copies else 1.0
        ways = []
        for weight, second in [(None, None), *lattice.REPEATS]:
            score, past, pairs, behind, before, i = 0.0, Counter(), Counter(), Counter(), None, 0
            for phrase in phrases(t):
                inside = 0.0
                for w in phrase:
                    p = word(w) if weight is None else (past[w] + weight * word(w)) / (i + weight)
                    if second is not None:
                        p = (pairs[before, w] + second * p) / (behind[before] + second)
                    inside += math.log10(p)
                    past[w] += 1
                    pairs[before, w] += 1
                    behind[before] += 1
                    before, i = w, i + 1
                copied = max(copies[phrase] - left, 0) / sum(copies.values()) if copies else 0.0
                score += math.log10(copied + spelled * 10**inside)
            ways.append(score)
        top = max(ways)
        yield top + math.log10(np.mean([10 ** (x - top) for x in ways])), sum(math.log10(word(w)) for w in t)


def compare(spark, rows):
    importable(spark)
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lattice.score_texts(frame, vocabulary("piece_bpe_32k.model"), lattice.seventh()).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    found = sorted(((r["doc_id"], r["score"], r["lattice_score"]) for r in got), key=order)
    want = sorted(((i, *s) for (i, _), s in zip(rows, expected_scores(rows))), key=order)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert np.allclose([r[1:] for r in found], [r[1:] for r in want], rtol=1e-9)
    return found


def test_scores_equal_counts_without_the_text_itself(spark):
    assert {held(i) for i, _ in TEXTS} == {True, False}
    compare(spark, TEXTS)


def test_small_corpora(spark):
    taught = [i for i in range(40) if not held(i)]
    tested = [i for i in range(40) if held(i)]
    compare(spark, [(taught[0], "alone alone in training"), (tested[0], "alone out of it")])
    compare(spark, [(taught[0], None), (taught[1], ""), (tested[0], "words")])
    compare(spark, [(tested[0], "nothing to learn from"), (tested[1], None)])


def test_a_training_text_does_not_teach_itself(spark):
    taught = [i for i in range(60) if not held(i)]
    rows = [(i, f"w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f w{i}g w{i}h") for i in taught[:20]]
    twins = [(taught[20], "k1 k2 k3 k4 k5 k6 k7 k8"), (taught[21], "k1 k2 k3 k4 k5 k6 k7 k8")]
    found = {i: s for i, s, _ in compare(spark, rows + twins)}
    # A text that occurs twice is known from its twin; one that occurs once is not known at all.
    assert min(found[i] for i, _ in twins) > max(found[i] for i, _ in rows) + 5
