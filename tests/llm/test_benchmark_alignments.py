"""Benchmark items in documents, against every item laid at every place."""

import random

from siftline.llm import decontamination
from siftline.llm.storage import importable

WORDS = "ant bee cow dog elk fox gnu hen".split()


def sentence(rng, size, words):
    """Words with a number now and then; never more than two in five words."""
    out = []
    while len(out) < size:
        out.append(rng.choice("3 7 12 40".split()) if len(out) % 3 == 1 and rng.random() < 0.4 else rng.choice(words))
    return out


def laid_everywhere(item, doc):
    """Windows of the item that the document holds, slots at most, all values equal."""
    held, slots, equal = set(), 0, True
    for shift in range(-len(item), len(doc)):
        against = [doc[k + shift] if 0 <= k + shift < len(doc) else None for k in range(len(item))]
        agrees = [a == b or (b is not None and a.isdigit() and b.isdigit()) for a, b in zip(item, against)]
        windows = [i for i in range(len(item) - 4) if all(agrees[i : i + 5])]
        pairs = {(item[k], against[k]) for i in windows for k in range(i, i + 5) if item[k].isdigit()}
        if windows and len(pairs) <= 1.1 * len({a for a, _ in pairs}):
            held.update(windows)
            slots = max(slots, len(pairs))
            equal &= all(a == b for a, b in pairs)
    return held, slots, equal


def cases(rng):
    items = [(i, sentence(rng, rng.randint(5, 30), WORDS[: rng.choice((2, 8))])) for i in range(40)]
    docs = []
    for d in range(150):
        _, item = rng.choice(items)
        other = {n: rng.choice("5 8 40 99".split()) for n in ("3", "7", "12", "40")}
        body = [other.get(w, w) for w in item] if d % 3 == 1 else list(item)
        if d % 5 == 2 and len(body) > 12:
            body[rng.randrange(len(body))] = rng.choice(WORDS)
        if d % 7 == 3:
            body = body[: rng.randint(3, len(body))]
        docs.append((d, sentence(rng, rng.randint(0, 12), WORDS) + body + sentence(rng, rng.randint(5, 12), WORDS)))
    # One text with very many places of the same items.
    docs.append((150, sentence(rng, 3000, WORDS[:2])))
    return items, docs


def test_equals_every_alignment(spark):
    importable(spark)
    items, docs = cases(random.Random(7))
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(w), 0) for i, w in rows], f"{name} long, text string, size int").repartition(3)
    got = {
        (r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["verbatim"])
        for r in decontamination.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()
    }
    want = {}
    for d, doc in docs:
        for i, item in items:
            held, slots, equal = laid_everywhere(item, doc)
            if len(held) >= 0.8 * (len(item) - 4):
                want[d, i] = (len(item) - 4, len(held), slots, equal)
    assert got == want
    assert len({d for d, _ in want}) > 100 and any(not v[3] for v in want.values()) and any(v[1] < v[0] for v in want.values())


def test_only_stretches_are_joined_with_items(spark, monkeypatch):
    """Whole texts do not stand in the rows that meet the items."""
    importable(spark)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    words = "the old grey fox runs past the quiet river bank".split()
    texts = spark.createDataFrame([(1, " ".join(["noise"] * 20000 + words * 50))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = decontamination.contaminated(texts, items)
    assert [(r["doc_id"], r["item_id"], r["verbatim"]) for r in found.collect()] == [(1, 1, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner, ((item_id")
    assert "slice(words" in plan[join:] and plan[join:].index("slice(words") < plan[join:].index("Generate explode(places")
