"""Phrase mining, ranked search and toxicity against brute force, on odd rows and on held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cargolens.llm import phrases, ranked_search, toxicity

ODD = [(1, "One two, three. one two three\nONE TWO three", "en", "a"), (1, "One two, three. one two three\nONE TWO three", "en", "a"), (2, None, "en", "b"),
       (3, "", None, None), (4, " \n\t ,;: ", "en", "b"), (None, "one two three", None, "c"), (5, "word " * 30000, "de", "d"), (6, "ß é 😀 \x00 y a-b Ä", "und", "e"),
       (7, "one two three one two four one two", "de", "e"), (8, "x" * 200000, "fr", "f")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(frame):
    from pyspark.sql import functions as F

    return frame(ODD, SCHEMA).withColumns({"words": F.lit("x"), "rank": F.lit(1), "score": F.lit("t"), "n": F.lit(2), "key": F.lit(3), "slot": F.lit(4), "item": F.lit("i")})


@pytest.fixture(scope="module")
def nothing(frame):
    return frame([], SCHEMA)


# Phrases

def brute_phrases(rows, least, longest=3, top=2000, covered=50):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i:i + k]] = max(most[p[i:i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * most[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


def mined(df, **how):
    rows = phrases.mine(df, **how).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_phrases_odd_rows(odd):
    want = brute_phrases([(r[1], r[2]) for r in ODD], 2)
    assert ("en", "one two three") in {(r[0], r[2]) for r in want} and mined(odd, least=2) == want
    assert mined(odd, least=10_000) == brute_phrases([(r[1], r[2]) for r in ODD], 10_000)


def test_phrases_empty(nothing):
    assert mined(nothing) == set()


@pytest.mark.parametrize("longest", [2, 4])
def test_phrases_of_other_sizes(docs, longest):
    some = docs.select("text", "lang")
    rows = [tuple(r) for r in some.collect()]
    assert mined(some, least=20, longest=longest, top=50) == brute_phrases(rows, 20, longest, 50)


def test_phrases_with_a_small_trie(docs, monkeypatch):
    """Bursts, spilled subtrees, prefixes that go on below common words: the counts stay the same."""
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    pa_words = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] or "und" for r in rows])], names=["text", "lang"])
    monkeypatch.setattr(phrases, "TRIE", 2000)
    monkeypatch.setattr(phrases, "BURST", 100)

    class Sent:
        value = np.full(phrases.BITS // 64, np.uint64(2**64 - 1)), None

    ids, counts = np.unique(np.concatenate([x[1] for x in phrases._words(pa_words, 0)]), return_counts=True)
    Sent.value = Sent.value[0], ids[counts > 20]
    slots = 64
    runs = list(phrases._counted(Sent, 3, 0, slots)([pa_words]))
    assert len(runs) > 8  # the blocks of a language are added one by one
    table = pa.Table.from_batches(runs).combine_chunks().sort_by("slot")
    assert len(set(table["slot"].to_pylist())) > slots / 2
    found = Counter()
    for batch in phrases._joined(3, 1)(iter(table.to_batches(50))):
        for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
            assert tuple(words) not in found
            found[tuple(words)] = n
    want = Counter()
    for _, ids, piece, _, _, _ in phrases._words(pa_words, 0):
        ids = ids.view(np.int64).tolist()
        want.update(tuple(ids[i:i + 3]) for i in range(len(ids) - 2) if piece[i] == piece[i + 2])
    assert found == want


def test_phrases_with_equal_hashes():
    words = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], np.uint64)
    g = phrases.Grams(np.zeros(5, np.uint64), np.zeros(5, np.int64), words, np.arange(1, 6))
    out = phrases.Grams.merged([g])
    assert {tuple(map(int, w)): int(n) for w, n in zip(out.words, out.n)} == {(1, 2): 4, (3, 4): 6, (5, 6): 5}


# Search

def brute_search(docs, queries, top=10):
    def terms(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    held = [(key, Counter(t), len(t)) for key, text in docs for t in [terms(text)] if t]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in set(queries):
        scores = []
        for row, (key, c, size) in enumerate(held):
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0, row))
        out |= {(item, i + 1, None if none else key, -s, text) for i, (s, none, key, _) in enumerate(sorted(scores)[:top])}
    return {r[:4] for r in out}


def searched(docs, queries, **how):
    return sorted((tuple(r) for r in ranked_search.rank(docs, queries, **how).collect()), key=repr)


QUERIES = [(1, "one two"), (1, "one two"), (2, "TWO two four zzz"), (3, None), (4, "..."), (None, "three"), (5, "word é ß ä"), (6, "x" * 200000)]


def test_search_odd_rows(odd, frame):
    queries = frame(QUERIES, "item_id long, text string")
    want = brute_search([(r[0], r[1]) for r in ODD], QUERIES)
    assert searched(odd, queries) == sorted(want, key=repr) and len(want) > 8
    assert searched(odd, queries, top=1) == sorted((r for r in want if r[1] == 1), key=repr)


def test_search_empty(odd, nothing, frame):
    queries = frame(QUERIES, "item_id long, text string")
    assert searched(nothing, queries) == [] and searched(odd, queries.limit(0)) == []


def test_search_small_blocks(spark, folder, docs):
    """Indexes of some entries each, and several blocks of queries, give the same rows."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute_search(rows, asked), key=repr)
    assert searched(docs, items) == want
    terms = ranked_search.TERMS
    try:
        ranked_search.TERMS = 300
        assert searched(docs, items) == want
    finally:
        ranked_search.TERMS = terms


def test_index_leaves_early_and_is_exact():
    draw = np.random.default_rng(3)
    weight = draw.integers(0, 2000, 80)
    queries = [(np.sort(draw.choice(80, k, replace=False)), draw.integers(1, 4, k)) for k in (1, 3, 20, 80)]
    best = [[] for _ in queries]
    everything = [[] for _ in queries]
    reads = []
    for block in range(6):
        size = 700
        tf = draw.poisson(0.4, (size, 80)) * (draw.random((size, 1)) < (1 if block == 0 else 0.3))
        tf[draw.integers(0, size, 200)] = tf[0]  # ties
        n = tf.sum(axis=1) + 5
        plan = ranked_search.Plan(weight, queries, 4000, 130_000, 10)
        doc, term = np.nonzero(tf)
        keys = (block * size + np.arange(size)).tolist()
        index = ranked_search.Index(plan, keys, n, doc, term, tf[doc, term])
        m = 25 + (75 * n * 4000) // 130_000
        impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))
        for q, (terms, repeats) in enumerate(queries):
            best[q] = index.best(terms, repeats, best[q], 10)
            scores = (impact[:, terms] * repeats).sum(axis=1)
            everything[q] += [(int(s), k) for s, k in zip(scores, keys) if s > 0]
            assert best[q] == sorted(everything[q], key=lambda x: (-x[0], x[1]))[:10]


# Toxicity

def toy(n=400):
    draw = np.random.default_rng(1)
    syllables = ["ra", "to", "mi", "ne", "sol", "ken", "ul", "par"]
    word = lambda: "".join(draw.choice(syllables, draw.integers(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(draw.integers(3, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(int(draw.integers(0, len(words) + 1)), "zug" + word())
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def taught(frame):
    rows, labels = toy()
    docs = frame(rows, SCHEMA)
    model = toxicity.learn(docs.where(~toxicity.held_out()), frame(labels, "doc_id long, toxic int"))
    return docs, dict(labels), model


def test_toxicity_held_out(taught):
    docs, labels, model = taught
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(labels) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    assert right > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_toxicity_odd_rows(taught, odd, nothing):
    _, _, model = taught
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1 and len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert toxicity.score(nothing, model).collect() == []


def test_toxicity_anywhere_in_a_long_text(taught, frame):
    _, _, model = taught
    filler = "ratomi nesol " * 20000
    rows = [(1, filler, "", ""), (2, filler + "zugra zugmi zugken", "", ""), (3, "zugra zugmi zugken " + filler, "", ""), (4, filler + "zugra zugmi zugken " + filler, "", "")]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(rows, SCHEMA), model).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 1}


def test_toxicity_without_labels(odd, frame):
    for given, want in ([], 0.0), ([(1, 0), (2, None), (None, 1)], 0.0), ([(1, 1)], 1.0):
        model = toxicity.learn(odd, frame(given, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score(odd, model).collect()} == {want}


def test_windows_cover_every_word():
    count = np.array([0, 1, 16, 17, 31, 32, 33, 48, 49, 1000])
    row, first, size = toxicity._windows(count)
    for r, n in enumerate(count):
        mine = row == r
        covered = Counter(int(i) for f, s in zip(first[mine], size[mine]) for i in range(f, f + s))
        assert sorted(covered) == list(range(n)) and mine.any()
        inner = [covered[i] for i in range(toxicity.STRIDE, max(toxicity.STRIDE, n - toxicity.STRIDE))]
        assert n <= toxicity.WIDTH or set(inner) == {2}


def test_gradient_by_differences():
    """Back-propagation against finite differences of the loss, in each parameter of the network."""
    draw = np.random.default_rng(2)
    texts = pa.array(["alpha beta gamma delta", "beta epsilon zeta"], pa.large_string())
    from cargolens.llm import common

    data, offsets = next((d, o) for _, _, d, o in common.text_blocks(texts))
    starts, ends, rows = common.word_spans(data, offsets, toxicity.OUTSIDE)
    words = toxicity.Words(data, starts, ends)
    row, first, size = toxicity._windows(np.bincount(rows))
    first = first + np.array([0, 4])
    places = toxicity._places(first, size, words.of, len(words.hash))
    label, weight = np.array([1, 0]), np.ones(2)
    model = toxicity.Model(words.hash[:3])
    for k in model.p:
        model.p[k] = (model.p[k] + draw.normal(0, 0.2, model.p[k].shape)).astype(np.float64)

    def loss():
        s = model.scores(model.inputs(words), places)
        return np.mean(np.log1p(np.exp(-np.where(label == 1, s, -s))))

    before = {k: v.copy() for k, v in model.p.items()}
    trainer = toxicity.Trainer(model, words)
    for v in trainer.square.values():
        v[:] = 1e12  # the step is then RATE * gradient / 1e6, and squares hardly change
    trainer.step(places, label, weight)
    step = {k: (before[k] - model.p[k]) * 1e6 / toxicity.RATE for k in before}
    model.p = before
    for k, v in before.items():
        flat, got = v.reshape(-1), step[k].reshape(-1)
        for i in sorted(set(np.argsort(-np.abs(got))[:3].tolist())):
            keep, size_ = flat[i], 1e-3
            flat[i] = keep + size_
            up = loss()
            flat[i] = keep - size_
            down = loss()
            flat[i] = keep
            assert got[i] == pytest.approx((up - down) / (2 * size_), rel=0.05, abs=2e-4), k
