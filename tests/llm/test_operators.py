"""Every operator against a brute-force version on small tables with nulls, empty
and long texts, ties, repeated rows, clashing columns and no rows at all."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontamination, grid_join, lattice, packing, quality, simhash, token_counts, token_files, toxicity, warc
from siftline.llm.components import components
from siftline.llm.encoding import Encoder
from siftline.llm.queries import vocabulary
from siftline.llm.storage import importable, shared_root

DOCS = "doc_id long, text string, source string, lang string, fp string, score double, words string, id long"
LONG = " ".join(f"word{i % 977} and" for i in range(9000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the old dog"),
    (2, "the CAT sat on the mat and looked at the old dog"),
    (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, LONG), (8, LONG + " end"), (9, "Größe ñandú 日本語 naïve"),
    (9, "Größe ñandú 日本語 naïve"), (None, "a text without id"), (None, None), (10, "x" * 5000), (11, "tail  with\n\n  runs \n "),
]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(i, t, "s", "en", "fp", 0.5, "w", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    encoder, rng = Encoder(vocabulary(name)), random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", " \n", "é", "23", "²", "'s", "!", "’", "\xa0", "​", "<|endoftext|>", "\x1c", "ß", "_", "日本", " The", "\x00", "́"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        ids, starts = encoder.encode([text, None, text])
        assert ids.tolist() == 2 * encoder.whole(text)
        assert starts[1] == starts[2]


def test_token_files_round_trip(spark, docs):
    path = shared_root(spark)
    token_files.write_token_files(docs, path, vocabulary("word_bpe_49k.json"))
    rows = token_files.with_starts(token_files.id_digests(token_files.read_token_files(spark, path)), path).collect()
    library, place = Encoder(vocabulary("word_bpe_49k.json")), {}
    assert len(rows) == len(TEXTS)
    total = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
        place.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    for key in {i for i, _ in TEXTS}:
        want = [library.whole(t or "") + [1] for i, t in TEXTS if i == key]
        assert sorted(place[key]) == sorted((len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want)
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_of_nothing(spark, docs):
    path = shared_root(spark)
    token_files.write_token_files(docs.limit(0), path, vocabulary("word_bpe_49k.json"))
    assert token_files.with_starts(token_files.read_token_files(spark, path), path).count() == 0


def test_packing_places_every_piece_once(spark, docs):
    capacity, library = 64, Encoder(vocabulary("byte_bpe_50k.json"))
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity).collect()
    pieces = Counter()
    for doc, text in TEXTS:
        ids = library.whole(text or "") + [0]
        first, begin = len(ids) % capacity or capacity, 0
        for k, end in enumerate(range(first, len(ids) + 1, capacity)):
            pieces[doc, k, begin, np.array(ids[begin:end], "<u4").tobytes()] += 1
            begin = end
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == pieces
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= capacity
    assert packing.pack(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_plans_are_close_to_the_bound():
    rng = random.Random(5)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert packing.make_plan(dict(counts), 2048).sequences <= 1.02 * bound
    assert packing.make_plan({1500: 10, 700: 10}, 2048).sequences == 15
    assert packing.make_plan({}, 2048).sequences == 0


def fingerprint(text):
    from xxhash import xxh64_intdigest

    w = words(ascii_lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    prints = {i: fingerprint(t) for i, t in TEXTS if i is not None}
    reach = {i: {j for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 2} for i in prints}
    for _ in prints:
        reach = {i: set().union(*(reach[j] for j in js)) for i, js in reach.items()}
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
            assert r["component_id"] == min(reach[r["doc_id"]])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({min(js) for js in reach.values()})
    assert ids.count(None) == 2
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_every_close_fingerprint_pair_is_found(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(20)]
    near = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(15)} | set(centres)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(near)]
    frame = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(frame).collect()}
    assert got == {(i, j) for i, x in enumerate(signed) for j, y in enumerate(signed) if i < j and bin((x ^ y) % (1 << 64)).count("1") <= 2}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 4), (5, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_grid_join(spark, monkeypatch):
    importable(spark)
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (1, 1, 1, 2):
        centre = rng.normal(size=16)
        for _ in range(30):
            rows.append((k, (centre + rng.normal(scale=0.25, size=16)).tolist(), label))
            k += 1
    rows += [(k, rows[0][1], 1), (k + 1, rows[0][1], 2), (k + 2, None, 1), (k + 3, [0.0] * 16, 1), (k + 4, [float("nan")] * 16, 1)]
    rows += [(k + 5, [None] + [1.0] * 15, 1), (k + 6, rows[0][1], None), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [float("inf")] * 16, 1), (k + 10, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vectors = {}
    for i, v, label in rows:
        fine = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        vectors[i] = (label, len(v), np.array(v) / np.linalg.norm(v)) if fine else None
    linked = lambda a, b: a is not None and b is not None and a[:2] == b[:2] and a[2] @ b[2] >= 0.93
    links = {i: {j for j in vectors if j != i and linked(vectors[i], vectors[j])} for i in vectors}
    reach = {i: js | {i} for i, js in links.items()}
    for _ in range(8):
        reach = {i: set().union(*(reach[j] for j in js)) for i, js in reach.items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_join.similar_vectors(frame).collect()}
    assert got == {i: (len(links[i]), min(reach[i]), min(reach[i]) == i) for i in vectors}
    assert grid_join.similar_vectors(frame.limit(0)).count() == 0


def test_halving_finds_the_same_links():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12))
    x = grid_join._unit(x[np.argsort(x[:, 0])])
    assert (grid_join.links_of(x, x, 0.9) == (x @ x.T >= 0.9)).all()


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    scores = np.log(np.arange(1, 9) / 36)

    def total(text):
        ways = 0.0 if text else 1.0
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                ways += np.exp(scores[pieces.index(text[:k])]) * total(text[k:])
        return ways

    found = lattice.Lattice(pieces, scores).marginals([b"abab", b"a", b"bba", b""])
    assert np.allclose(found, [np.log(total("▁" + w)) for w in ("abab", "a", "bba", "")])


def test_lattice_scores(spark, docs):
    rows = lattice.score_texts(docs, vocabulary("piece_bpe_32k.model"), lattice.seventh()).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in TEXTS if not held(i) for w in [*words(ascii_lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in TEXTS:
        tokens = [*words(ascii_lower(t)), None]
        want[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert len({r["score"] for r in rows if r["n_tokens"] == 1}) == 1
    assert lattice.score_texts(docs.limit(0), vocabulary("piece_bpe_32k.model"), lattice.seventh()).count() == 0


def test_long_unseen_words_cost_their_pieces(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learnt = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rng = random.Random(1)
    letters = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1600))
    for training in ("the cat and the dog", ""):
        rows = [(learnt, training), *[(held, letters[:n]) for n in (200, 400, 1600)], (held, letters[:400] + " " + letters[:400])]
        found = lattice.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("piece_bpe_32k.model"), lattice.seventh()).collect()
        score = sorted(((r["n_tokens"], -r["score"]) for r in found if r["doc_id"] == held))
        one = [x for n, x in score if n == 2]
        assert 300 < one[0] and np.isclose(one[1] / one[0], 2, atol=0.2) and np.isclose(one[2] / one[1], 4, atol=0.4)
        # Its repeat is the same word again, not a second unseen one.
        assert one[1] < score[-1][1] < one[1] + 10
    far, near = (lattice.text_scores(np.array([0, 1, 0, 2]), np.array([4]), np.array([p, -1.0, -0.5]), np.array([4]), np.array([-np.inf]), 0.0)[0] for p in (-5000.0, -250.0))
    assert np.isclose(near - far, 4750)


def test_lattice_paths_of_repeats_and_phrases():
    """Token by token, phrase by phrase, against the array form."""
    rng = np.random.default_rng(3)
    hashes = np.append(rng.integers(0, 2**63, 12).astype(np.uint64), np.uint64(0))
    lengths = np.array([1, 40, 7, 1, 90])
    tokens = np.concatenate([np.append(rng.integers(0, 12, n - 1) // rng.integers(1, 4), 12) for n in lengths])
    logs = np.log10(np.full(13, 1 / 20))
    spelled, seen = -0.2, {}
    found, sizes = lattice.phrases_of(tokens, lengths, hashes)
    texts, at = [], 0
    for n in lengths:
        cut, part = [[]], tokens[at : at + n].tolist()
        for w in part:
            cut[-1].append(w)
            if hashes[w] % 8 == 0 or len(cut[-1]) == lattice.PHRASE:
                cut.append([])
        texts.append([c for c in cut if c])
        at += n
    flat = [tuple(c) for t in texts for c in t]
    assert [len(c) for c in flat] == sizes.tolist() and len(set(flat)) == len(set(zip(flat, found)))
    copied = np.array([seen.setdefault(c, -2.0 if len(seen) % 2 else -np.inf) for c in flat])
    want = []
    for t in texts:
        ways = []
        for k, second in [(None, None), *lattice.REPEATS]:
            score, past, pairs, i = 0.0, Counter(), Counter(), 0
            before, contexts = None, Counter()
            for c in t:
                words_in = 0.0
                for w in c:
                    p = 10 ** logs[w] if k is None else (past[w] + k * 10 ** logs[w]) / (i + k)
                    if second is not None:
                        p = (pairs[before, w] + second * p) / (contexts[before] + second)
                    words_in += np.log10(p)
                    past[w] += 1
                    pairs[before, w] += 1
                    contexts[before] += 1
                    before, i = w, i + 1
                score += np.log10(10 ** seen[tuple(c)] + 10 ** (spelled + words_in))
            ways.append(10**score)
        want.append(np.log10(np.mean(ways)))
    assert np.allclose(lattice.text_scores(tokens, lengths, logs, sizes, copied, spelled), want)


LABELS = "doc_id long, quality int, toxic int, text string"


def labelled_texts(rng, n=240):
    clean = ["the", "river", "runs", "past", "old", "stones", "quietly", "again", "and", "birds", "sing"]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        bad = i % 3 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "vilewords", "vileness"]))
        rows.append((i, " ".join(w) if i % 4 else " ".join(x + "|" for x in w), int(i % 4 > 0), int(bad)))
    return rows


def test_toxicity_and_quality(spark, docs):
    rows = labelled_texts(random.Random(1))
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x, "clash") for i, _, q, x in rows] + [(None, 1, 1, ""), (5, None, None, "")], LABELS)
    network = toxicity.fit(texts, labels)
    got = toxicity.scores(texts, network).collect()
    truth = {i: x for i, _, _, x in rows}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    odd = toxicity.scores(docs, network).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_clean(docs, network)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in odd)

    stats = quality.statistics_table(texts)
    model = quality.fit(stats, labels)
    truth = {i: q for i, _, q, _ in rows}
    held = [r for r in quality.scores(stats, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    odd = quality.scores(quality.statistics_table(docs), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(docs, model).count() == sum(r["predicted"] for r in odd)


def test_classifiers_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    network = toxicity.fit(docs, none)
    assert {r["score"] for r in toxicity.scores(docs, network).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), network).count() == 0
    model = quality.fit(quality.statistics_table(docs), none)
    assert {r["score"] for r in quality.scores(quality.statistics_table(docs), model).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_isotonic_levels():
    levels = quality.isotonic(np.array([0, 3, 1, 4.0]), np.array([4, 4, 4, 4.0]))
    assert (np.diff(levels) >= 0).all() and levels[1] == levels[2]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    windows = rng.integers(0, 9, (5, toxicity.WINDOW))
    gates = rng.normal(size=(9, 6 * toxicity.HIDDEN)).astype(np.float32)
    goals = np.array([0, 1, 1, 0, 1], np.float32)

    def loss():
        z = net.pool(net.read(gates, windows), windows)[2].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - goals * z))

    steps = []
    states = net.read(gates, windows, steps)
    weight, pooled, z = net.pool(states, windows)
    grads, _ = toxicity._backward(net, steps, states, windows, weight, pooled, ((1 / (1 + np.exp(-z)) - goals) / 5).astype(np.float32))
    for name in ("recurrent", "attention", "output", "bias"):
        value = getattr(net, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        before = value[at]
        value[at] = before + 1e-2
        up = loss()
        value[at] = before - 1e-2
        down = loss()
        value[at] = before
        assert np.isclose((up - down) / 2e-2, grads[name][at], rtol=0.05)


def test_contaminated(spark):
    item = "A train leaves Paris at 60 km per hour, and meets the Bob train after 60 minutes of travel near old bridge"
    other = item.replace("60", "75").replace("Paris", "London").replace("Bob", "Eve")
    items = spark.createDataFrame([(1, item, 0), (2, "one two three", 0), (3, None, 0), (None, item, 0)], "item_id long, text string, doc_id int")
    rows = [
        (1, f"noise before. {item} and after"), (2, f"noise before. {other} and after"), (3, f"noise. {other} and after".replace("75 minutes", "80 minutes").replace("75 km", "70 km")),
        (None, other), (5, "One, two; three!"), (6, "one two three four five six"), (7, None), (8, ""), (9, "..."), (1, f"noise before. {item} and after"), (10, item[: len(item) // 2]),
    ]
    texts = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, words string, hash int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(texts, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (5, 2)}
    assert got[1, 1]["verbatim"] and not got[2, 1]["verbatim"]
    left = decontamination.drop_contaminated(texts, items)
    assert left.columns == texts.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 6, 7, 8, 9, 10]
    assert decontamination.drop_contaminated(texts.limit(0), items).count() == 0
    assert decontamination.drop_contaminated(texts, items.limit(0)).count() == len(rows)


def found_in(spark, item, texts):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in decontamination.contaminated(rows, items).collect()}


def test_items_of_many_slots(spark):
    item = "Compute 12 + 7 * 3 - 4 / 2 + 9 - 8"
    got = found_in(spark, item, [f"so {item} is asked", item.lower(), "Compute 11 + 6 * 5 - 3 / 1 + 8 - 9", "12 7 3 4 2 1 5 6 7 8"])
    assert set(got) == {0, 1} and got[0]["n_windows"] == 4 and got[0]["verbatim"]
    got = found_in(spark, "What is 17 x 23 + 5 - 9?", ["what is 4 x 5 and no more of it", "they ask what is 4 x 5 + 6 - 7 today", "what is 17 x 23 + 5 - 9"])
    assert set(got) == {1, 2} and got[1]["coverage"] == 1 and not got[1]["verbatim"] and got[2]["verbatim"]


def test_items_in_other_case_and_lines(spark):
    item = "Tom has 5 apples. Tom buys 3 more from Mr. Smith and gives Anna the half of them, so how many are left for Tom"
    other = item.replace("Tom", "Bob").replace("Smith", "Jones").replace("Anna", "Eve").replace("5", "8")
    mixed = item.replace("Tom buys", "Ann buys").replace("Tom has", "Joe has")
    wrapped = other.replace(" Eve", "\n  Eve").replace(" Jones", "\nJones").replace(" Bob", "  Bob")
    got = found_in(spark, item, [item.lower(), item.upper(), wrapped, other, mixed, "Tom has 5 apples. Tom likes them all and never gives Anna a half of them"])
    assert set(got) == {0, 1, 2, 3}
    assert got[0]["verbatim"] and got[1]["verbatim"] and not got[2]["verbatim"]
    assert set(found_in(spark, item.lower(), [item, other.lower(), "it took 60\nKm"])) == {0}
    assert set(found_in(spark, "the old car went 60 km to the sea", ["the old car went 75\n KM to the sea", "the old car went home"])) == {0}


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    test_contaminated(spark)


def test_decontamination_runs_no_python(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = decontamination.contaminated(frame, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rollup_applies_each_batch_once(spark):
    feed = "doc_id long, source string, lang string, text string, seq int, op string, n_docs int"
    first = [(1, "a", "en", "one two", 0, "upsert", 0), (2, "a", None, "x", 0, "upsert", 0), (3, None, "en", None, 0, "upsert", 0), (None, "a", "en", "no id", 0, "upsert", 0)]
    second = [(1, "b", "en", "one two 3!", 0, "upsert", 0), (2, None, None, None, 1, "delete", 0), (2, "a", None, "y z", 0, "upsert", 0), (9, None, None, None, 0, "delete", 0)]
    third = [(2, "a", "en", "back", 0, "upsert", 0), (1, None, None, None, 0, "delete", 0), (1, None, None, None, 0, "delete", 0)]
    rollup = token_counts.Rollup(spark, shared_root(spark))
    assert rollup.totals().count() == 0

    def state():
        return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in rollup.totals().collect()}

    def both(key, words_n, parts_n, docs_n, chars):
        return {(*key, "words-1"): (docs_n, words_n, chars), (*key, "word-parts-1"): (docs_n, parts_n, chars)}

    assert rollup.commit(1, spark.createDataFrame(first, feed))
    assert state() == {**both(("a", "en"), 4, 4, 2, 12), **both(("a", None), 1, 1, 1, 1), **both((None, "en"), 0, 0, 1, 0)}
    assert rollup.commit(2, spark.createDataFrame(second, feed))
    after = {**both(("a", "en"), 2, 2, 1, 5), **both(("b", "en"), 3, 4, 1, 10), **both((None, "en"), 0, 0, 1, 0)}
    assert state() == after
    assert not rollup.commit(2, spark.createDataFrame(second, feed))
    assert state() == after
    assert rollup.commit(3, spark.createDataFrame(third, feed))
    assert rollup.commit(4, spark.createDataFrame([], feed))
    assert state() == {**both(("a", "en"), 3, 3, 2, 9), **both((None, "en"), 0, 0, 1, 0)}


def test_a_broken_off_batch_is_written_afresh(spark):
    feed = "doc_id long, source string, lang string, text string, seq int, op string"
    rollup = token_counts.Rollup(spark, shared_root(spark))
    rows = spark.createDataFrame([(1, "a", "en", "one two", 0, "upsert")], feed)
    rollup._write(rows.limit(1).select("source", "lang", F.lit("words-1").alias("tokenizer"), *[F.lit(99).cast("long").alias(c) for c in ("n_docs", "n_tokens", "n_chars")]), "deltas", 7)
    assert rollup.totals().count() == 0
    rollup.commit(7, rows)
    assert {r["n_tokens"] for r in rollup.totals().collect()} == {2}


def test_warc_round_trip(spark):
    importable(spark)
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    html = [(1, "a" * 1200), (2, "a" * 1200), (5, "a" * 1200), (3, "b" * 999), (4, "b" * 999), (6, None), (7, ""), (8, big), (9, big), (9, big), (None, "a" * 1200)]
    rows = [(i, None if i == 3 else "http://x.y/a b\r\nX: 1", h, "clash") for i, h in html]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(2)
    got = warc.round_trip(frame).collect()
    assert len(got) == len(rows)
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    size = lambda h: len((h or "").encode())
    want = Counter()
    for i, h in html:
        top = max((j for j, g in html if g == h and j is not None), default=None)
        again = size(h) >= 1000 and i != top and i is not None
        want[i, size(h), digest(h), "revisit" if again else "response", top if again else None] += 1
    want[9, size(big), digest(big), "response", None] -= 1
    want[9, size(big), digest(big), "revisit", 9] += 1
    key = lambda r: (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
    null = [key(r) for r in got if r["page_id"] is None]
    assert len(null) == 1 and null[0][1:3] == (1200, digest("a" * 1200))
    assert Counter(key(r) for r in got if r["page_id"] is not None) == +Counter({k: n for k, n in want.items() if k[0] is not None})
    assert warc.round_trip(frame.limit(0)).count() == 0
