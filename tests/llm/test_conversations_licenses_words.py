"""Prefix trie, license scan and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siftline.llm import license_scan, prefix_trie, spelling
from siftline.llm.storage import importable

TURNS = "conv_id long, turn long, role string, text string, depth long, ka string, at string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
        built[c] = tuple(own.get(c - base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    found = set()
    for path, convs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in convs if built[c] == path)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        found.add((min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, digest))
    return found


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "k", "a") for r in rows], TURNS).repartition(3)
    trie = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(frame))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return trie, [tuple(r[c] for c in columns) for r in prefix_trie.digests(trie).collect()]


def conversations():
    rng, rows = random.Random(5), []
    for c in [*range(-7, 40), 1000, 1002, 10**12]:
        for turn in range(rng.choice([0, 1, 2, 3, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "bot"]) if turn else "user", rng.choice(["hi", "größe", ""]) if turn % 3 else "hello"))
    rows += [(3, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (None, 1, "user", "lost"), (50, 0, "user", None), (55, 0, "a", "b"), (57, None, "a", "b")]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    rows = conversations()
    trie, found = trie_of(spark, rows)
    assert len(found) == len(set(found))
    assert set(found) == brute_trie(rows)
    texts = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in trie.with_texts().collect()}
    assert len(texts) == len(found) and sum(d == 0 and v == (None, None) for (_, d), v in texts.items()) == 1


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    importable(spark)
    rows = [(5, i, "user", "same") for i in range(9000)] + [(10, i, "user", "same") for i in range(4500)]
    found = trie_of(spark, rows)[1]
    assert len(found) == 9001
    top = next(r for r in found if r[1] == 0)
    assert top == (5, 0, None, 2, 1, 1, 4500 * 4, hashlib.sha256(b"").hexdigest())
    assert next(r for r in found if r[1] == 4500)[5:] == (1, 4, hashlib.sha256(b"10").hexdigest())
    assert trie_of(spark, [])[1] == []


def test_end_lists_over_several_rows(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 10)
    rows = [(5 * c, 0, "user", "one") for c in range(300)]
    trie, found = trie_of(spark, rows)
    assert trie.ends.count() > 10
    assert {r[-1] for r in found if r[1] == 1} == {hashlib.sha256(",".join(str(5 * c) for c in range(300)).encode()).hexdigest()}


DOCS = "doc_id long, text string, template string, label string, n long, word string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "t", "l", 3, "w") for i, t in texts], DOCS).repartition(3)


def license_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def base_places(words):
    return sorted((i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def brute_coverage(words, template):
    """Greatest share of the template's pairs on neighbouring diagonals."""
    own = license_scan._plain_words(template)
    places = defaultdict(set)
    for i in range(len(words) - 1):
        for j in range(len(own) - 1):
            if words[i : i + 2] == own[j : j + 2]:
                places[i - j].add(j)
    reach = 0 if template.exact else license_scan.SHIFT
    return max((len(set().union(*[places[d + s] for s in range(reach + 1) if d + s in places])) / (len(own) - 1) for d in list(places)), default=0)


NOTICE = license_scan.NOTICES[0][0]
EDITED = NOTICE.replace("hereby", "now hereby").replace("publish, ", "").replace("substantial", "greater")
LICENSED = [
    (1, "Released under the MIT License. The mit-license"), (2, None), (3, ""), (4, "license"), (5, "mit license " * 400),
    (6, "A text.\n" + NOTICE + "\nand more"), (7, EDITED + " filler " * 500 + NOTICE), (8, NOTICE[: len(NOTICE) // 2]),
    (9, "GNU General Public License version 3"), (9, "GNU General Public License version 3"), (None, "Apache License, Version 2.0"), (None, None),
    (10, "the software " * 700), (11, "Grüße MİT License mit Licenſe MIT license"), (12, "word " * 20000 + "apache\tlicense"), (13, "\x00mit\x7flicense"),
    (14, "\n".join(n for n, _ in license_scan.NOTICES)),
]


def test_license_scan_equals_brute_force(spark):
    rows = license_scan.scan(docs_of(spark, LICENSED)).collect()
    assert len(rows) == len(LICENSED)
    want = Counter()
    for i, text in LICENSED:
        words = license_words(text)
        base = base_places(words)
        covered = {t: brute_coverage(words, t) for t in license_scan.TEMPLATES}
        held = {t: c for t, c in covered.items() if c >= (1 if t.exact else license_scan.COVERAGE)}
        want[(i, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b[1] for b in base})), ",".join(sorted({t.label for t in held})), round(max(held.values(), default=0), 9))] += 1
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert Counter((*[r[n] for n in names], round(r["score"], 9)) for r in rows) == want
    assert license_scan.scan(docs_of(spark, [])).collect() == []


def test_license_spans_tell_places(spark):
    found = license_scan.matches(docs_of(spark, LICENSED))
    spans = [r for r in license_scan.spans(found).collect() if r["doc_id"] == 7 and r["label"] == "mit"]
    words, own = license_words(LICENSED[6][1]), license_words(NOTICE)
    assert len(spans) == 2
    first, second = sorted(spans, key=lambda r: r["first_word"])
    assert (first["first_word"], first["coverage"] < 1) == (0, True)
    assert words[second["first_word"] : second["last_word"] + 1] == own and second["coverage"] == 1


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(texts):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows, forms = [], {}
    for w, n in known.items():
        close = [(-known[v], v) for v in known if near(w, v)]
        best = min(close, default=(0, None))
        forms[w] = best[1] if best[1] and -best[0] >= 10 * n else None
        rows.append((w, forms[w], n, len(close), -best[0] if forms[w] else None))

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, f, root(w), n, k, fn) for w, f, n, k, fn in rows}


WORDS = (
    [(i, "Spelling spelling") for i in range(60)] + [(100 + i, "speling splelling") for i in range(3)] + [(200 + i, "spelinng spellingÀ spellingà spelling÷") for i in range(2)]
    + [(300, "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa"), (300, None), (None, "spelling nullable nullable"), (301, ""), (302, "short words only"), (303, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 3000)]
    + [(304, "x" * 2999 + " " + "x" * 3000), (305, "Straße-straße straßen straßen STRASSE"), (306, "abcdefg bcdefga abcdefg bcdefga abcdefh abcdefh")]
)


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_variants_equal_brute_force(spark, seed):
    importable(spark)
    rng = random.Random(seed)
    texts = WORDS if seed is None else [(i, " ".join("".join(rng.choice("abç") for _ in range(rng.choice([6, 7, 7, 8]))) for _ in range(rng.choice([1, 5, 300])))) for i in range(12)]
    rows = spelling.variants(docs_of(spark, texts)).collect()
    found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows]
    assert len(found) == len(set(found))
    assert set(found) == brute_words(texts)


def test_no_words(spark):
    importable(spark)
    assert spelling.variants(docs_of(spark, [])).collect() == []
    assert spelling.variants(docs_of(spark, [(1, "no long ones")])).collect() == []


def test_ranges_share_nodes(spark):
    """Words dealt over many ranges number shared prefixes alike."""
    importable(spark)
    words = [f"prefix{'a' * k}" for k in range(40)]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    nodes = spelling.trie_nodes(frame.repartition(4))
    same = dict(spelling.border_nodes(nodes))
    number = {}
    for r in nodes.collect():
        for k, node in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:k], same.get(node, node)) == same.get(node, node)
    assert len(set(number.values())) == len(number)
