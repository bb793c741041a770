"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as the sum of two inputs: a vector of its own, if it is one of the words learnt, and the vectors of its
character n-grams. Two recurrent networks read a window from both ends; attention weighs its positions, and a
linear layer gives the window's score. A text is as toxic as its worst window; a logistic curve fitted on
texts kept out of the training turns that into a probability. Labels belong to whole texts, so training goes in rounds: the windows
of toxic texts that score highest are taken as toxic, the worst windows of the other texts as clean.

Everything is numpy: one task trains on a bounded sample of labelled texts, all tasks score all windows of all texts
with the model, which has a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm import common
from cargolens.llm.common import id_mod, mix, need

HELD_PARTS, HELD = 5, 0
#: Bounds of the training sample: texts of either label, and windows of a text, evenly spaced over all of it.
SAMPLE, TEXT_WINDOWS = 2048, 128
#: Words of a window, and from one window's first to the next one's: every word but those at the ends is in two windows.
WIDTH, STRIDE = 32, 16
#: Learnt words, buckets of character n-grams, their sizes.
WORDS, GRAMS, SIZES = 1 << 15, 1 << 16, (3, 4)
IN, HIDDEN = 16, 8
ROUNDS, BATCH, RATE = 5, 256, 0.02
#: Windows scored at once.
CHUNK = 4096
PARTS = ("r", "z", "n")

#: Words are made of digits, letters and all characters beyond ASCII.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = [not chr(i).isalnum() for i in range(128)]


class Words:
    """The distinct words of a block: hash, and buckets of their n-grams as one list with the word of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        folded = common.FOLD_CASE[data]
        h = common.word_hashes(folded, starts, ends)
        self.hash, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        starts, ends = starts[at], ends[at]
        grams, owner = [], []
        for n in SIZES:
            # Shorter words are a single n-gram as they are.
            count = np.maximum(ends - starts - n + 1, 1)
            who = np.repeat(np.arange(len(starts)), count)
            first = starts[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            last = np.minimum(first + n, ends[who])
            mark = np.where(first == starts[who], np.uint64(n), np.uint64(n + 16))
            grams.append((mix(common.word_hashes(folded, first, last) + mark) & np.uint64(GRAMS - 1)).astype(np.int64))
            owner.append(who)
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        self.ends = np.searchsorted(self.owner, np.arange(len(self.hash) + 1))


def _windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, words) of all windows; a row without words has one empty window."""
    n = np.maximum(1, -(-(count - STRIDE) // STRIDE))
    row = np.repeat(np.arange(len(count)), n)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return row, first, np.minimum(count[row] - first, WIDTH)


def _places(first: np.ndarray, size: np.ndarray, of: np.ndarray, pad: int) -> np.ndarray:
    """Word numbers of windows as rows of WIDTH, padded at the end."""
    at = first[:, None] + np.arange(WIDTH)
    inside = np.arange(WIDTH) < size[:, None]
    return np.where(inside, of[np.minimum(at, max(0, len(of) - 1))] if len(of) else pad, pad)


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the network's curve, from -1 to 1. Gates are (1 + it) / 2."""
    x /= np.abs(x) + 1
    return x


def _bend(y: np.ndarray) -> np.ndarray:
    """The slope of that curve where it has the value ``y``."""
    return np.square(1 - np.abs(y))


class Model:
    """Parameters by name, and the network forwards."""

    def __init__(self, words: np.ndarray, seed: int = 13):
        draw = np.random.default_rng(seed)
        self.words = words  # hashes, sorted
        p = {"word": draw.normal(0, 0.05, (len(words) + 1, IN)), "gram": draw.normal(0, 0.05, (GRAMS, IN))}
        for side in "fb":
            for part in PARTS:
                p[f"W{part}{side}"] = draw.normal(0, 0.4, (IN, HIDDEN))
                p[f"U{part}{side}"] = draw.normal(0, 0.3, (HIDDEN, HIDDEN))
                p[f"b{part}{side}"] = np.zeros(HIDDEN)
            p[f"attend{side}"] = draw.normal(0, 0.3, HIDDEN)
            p[f"out{side}"] = draw.normal(0, 0.3, HIDDEN)
        p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.slope, self.shift = 1.0, 0.0

    def number(self, words: Words) -> np.ndarray:
        """The learnt word of each distinct word; the last row stands for all unknown ones."""
        if not len(self.words):
            return np.zeros(len(words.hash), np.int64)
        at = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
        return np.where(self.words[at] == words.hash, at, len(self.words))

    def inputs(self, words: Words) -> np.ndarray:
        """A vector per distinct word."""
        if not len(words.hash):
            return np.zeros((0, IN), np.float32)
        count = np.diff(words.ends)
        chars = np.add.reduceat(self.p["gram"][words.grams], words.ends[:-1], axis=0)
        return self.p["word"][self.number(words)] + chars / np.sqrt(count)[:, None].astype(np.float32)

    def projected(self, x: np.ndarray, side: str) -> dict[str, np.ndarray]:
        """What the gates take from each word, with a last row for padding, which leaves the state as it is."""
        out = {}
        for part in PARTS:
            out[part] = np.concatenate([x @ self.p[f"W{part}{side}"] + self.p[f"b{part}{side}"], np.zeros((1, HIDDEN), np.float32)])
        out["z"][-1] = -1e12
        return out

    def scores(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The score of every window of ``places``."""
        out = np.empty(len(places))
        sides = {side: self.projected(x, side) for side in "fb"}
        for s in range(0, len(places), CHUNK):
            at = np.ascontiguousarray(places[s:s + CHUNK].T)
            e, v = (np.zeros(at.shape, np.float32) for _ in range(2))
            for side, steps in (("f", range(WIDTH)), ("b", range(WIDTH - 1, -1, -1))):
                table = sides[side]
                to_r, to_z, to_n = (self.p[f"U{part}{side}"] for part in PARTS)
                to_n, ends = to_n / 2, np.stack([self.p[f"attend{side}"], self.p[f"out{side}"]], axis=1)
                h = np.zeros((at.shape[1], HIDDEN), np.float32)
                for t in steps:
                    r = table["r"].take(at[t], axis=0)
                    r += h @ to_r
                    z = table["z"].take(at[t], axis=0)
                    z += h @ to_z
                    n = h @ to_n
                    _squash(r)
                    r += 1
                    n *= r
                    n += table["n"].take(at[t], axis=0)
                    _squash(n)
                    n -= h
                    _squash(z)
                    z += 1
                    n *= z
                    n *= 0.5
                    h += n
                    both = h @ ends
                    e[t] += both[:, 0]
                    v[t] += both[:, 1]
            e[at == len(x)] = -60
            e[0] = np.where((at == len(x)).all(axis=0), 0, e[0])
            e -= e.max(axis=0)
            np.exp(e, out=e)
            out[s:s + CHUNK] = (e * v).sum(axis=0) / e.sum(axis=0) + self.p["bias"][0]
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


class Trainer:
    """Back-propagation through windows; steps are scaled by the squares of earlier gradients."""

    def __init__(self, model: Model, words: Words):
        self.model, self.words, self.number = model, words, model.number(words)
        self.square = {k: np.full(v.shape if v.ndim < 2 or len(v) <= IN else (len(v), 1), 1e-6, np.float32) for k, v in model.p.items()}

    def step(self, places: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        p, words = self.model.p, self.words
        used, at = np.unique(places, return_inverse=True)
        at = at.reshape(places.shape).T
        real = used[used < len(words.hash)]
        inside = at < len(real)
        begin, end = words.ends[real], words.ends[real + 1]
        count = end - begin
        gram_of = np.repeat(np.arange(len(real)), count)
        grams = words.grams[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
        scale = (1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)
        x = p["word"][self.number[real]].copy()
        if len(grams):
            x += np.add.reduceat(p["gram"][grams], np.cumsum(count) - count, axis=0) * scale[:, None]
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        states, e, v = {}, np.zeros(at.shape, np.float32), np.zeros(at.shape, np.float32)
        for side, steps in (("f", list(range(WIDTH))), ("b", list(range(WIDTH - 1, -1, -1)))):
            table = self.model.projected(x, side)
            h = np.zeros((at.shape[1], HIDDEN), np.float32)
            kept = {}
            for t in steps:
                where = np.where(inside[t], at[t], len(real))
                r = _squash(table["r"][where] + h @ p[f"Ur{side}"])
                z = _squash(table["z"][where] + h @ p[f"Uz{side}"])
                hn = h @ p[f"Un{side}"] / 2
                n = _squash(table["n"][where] + (1 + r) * hn)
                new = h + (1 + z) / 2 * (n - h)
                kept[t] = (h, r, z, hn, n, new)
                h = new
                e[t] += h @ p[f"attend{side}"]
                v[t] += h @ p[f"out{side}"]
            states[side] = kept, steps
        e = np.where(inside, e, -60)
        share = np.exp(e - e.max(axis=0))
        share /= share.sum(axis=0)
        score = (share * v).sum(axis=0) + p["bias"][0]
        push = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - label) * weight / weight.sum()
        push = push.astype(np.float32)
        grad["bias"][0] = push.sum()
        to_v = share * push
        to_e = np.where(inside, share * (v - (share * v).sum(axis=0)) * push, 0).astype(np.float32)
        to_x = np.zeros((len(real), IN), np.float32)
        order = np.argsort(at.ravel(), kind="stable")
        begins = np.searchsorted(at.ravel()[order], np.arange(int(at.max()) + 1))
        for side in "fb":
            kept, steps = states[side]
            back = np.zeros((at.shape[1], HIDDEN), np.float32)
            gates = np.empty((WIDTH, at.shape[1], 3 * HIDDEN), np.float32)
            for t in reversed(steps):
                h, r, z, hn, n, new = kept[t]
                g = back + to_e[t][:, None] * p[f"attend{side}"] + to_v[t][:, None] * p[f"out{side}"]
                grad[f"attend{side}"] += to_e[t] @ new
                grad[f"out{side}"] += to_v[t] @ new
                gn = g * (1 + z) / 2 * _bend(n)
                gz = g * (n - h) / 2 * _bend(z)
                gr = gn * hn * _bend(r)
                gn_h = gn * (1 + r) / 2
                grad[f"Un{side}"] += h.T @ gn_h
                grad[f"Uz{side}"] += h.T @ gz
                grad[f"Ur{side}"] += h.T @ gr
                back = g * (1 - z) / 2 + gn_h @ p[f"Un{side}"].T + gz @ p[f"Uz{side}"].T + gr @ p[f"Ur{side}"].T
                gates[t] = np.concatenate([gr, gz, gn], axis=1)
            summed = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], begins, axis=0)[:len(real)]
            for part, all_ in zip(PARTS, np.split(summed, 3, axis=1)):
                grad[f"W{part}{side}"] += x.T @ all_
                grad[f"b{part}{side}"] += all_.sum(axis=0)
                to_x += all_ @ p[f"W{part}{side}"].T
        for k, g in grad.items():
            self.square[k] += g * g
            p[k] -= RATE * g / np.sqrt(self.square[k])
        if len(real):
            self._rows("word", self.number[real], to_x)
            self._rows("gram", grams, (to_x * scale[:, None])[gram_of])

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """A step of the vectors used."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, g = rows[first], np.add.reduceat(grad[order], first, axis=0)
        self.square[name][rows] += (g * g).mean(axis=1, keepdims=True)
        self.model.p[name][rows] -= RATE * g / np.sqrt(self.square[name][rows])


def _odds(df: np.ndarray, texts: int, other: np.ndarray, others: int) -> np.ndarray:
    """How much likelier a toxic text is to hold a thing than another text is, as a logarithm drawn to 0."""
    return np.log((df + 2) / (texts + 4)) - np.log((other + 2) / (others + 4))


def fit(column: pa.Array, label: np.ndarray, order: np.ndarray) -> Model:
    """Train on texts with labels 0 and 1. One in five, by ``order``, only fits the curve from scores to probabilities."""
    raw, spans, rows = [], [], []
    shift = row = 0
    for a, b, data, offsets in common.text_blocks(column):
        starts, ends, who = common.word_spans(data, offsets, OUTSIDE)
        raw.append(data)
        spans.append(np.stack([starts, ends]) + shift)
        rows.append(who + a)
        shift, row = shift + len(data), b
    data, spans, rows = np.concatenate(raw), np.concatenate(spans, axis=1), np.concatenate(rows)
    words = Words(data, spans[0], spans[1])
    count = np.bincount(rows, minlength=len(label))
    begin = np.cumsum(count) - count
    row, first, size = _windows(count)
    per_text = np.bincount(row, minlength=len(label))
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    step = np.maximum(1, -(-per_text // TEXT_WINDOWS))[row]
    use = number % step == 0
    row, first, size = row[use], first[use], size[use]
    places = _places(begin[row] + first, size, words.of, len(words.hash))
    held = order % 5 == 0 if (order % 5 != 0).any() else np.zeros(len(order), bool)
    # Texts that hold a word or an n-gram, by label.
    texts = np.array([((label == k) & ~held).sum() for k in (0, 1)])
    pair = np.unique(rows * np.int64(len(words.hash)) + words.of)
    doc, word = pair // max(1, len(words.hash)), pair % max(1, len(words.hash))
    doc, word = doc[~held[doc]], word[~held[doc]]
    df = [np.bincount(word[label[doc] == k], minlength=len(words.hash)) for k in (0, 1)]
    often = np.flatnonzero(df[0] + df[1] > 1)
    often = often[np.lexsort((words.hash[often], -(df[0] + df[1])[often]))][:WORDS]
    often = np.sort(often)  # by hash, as words are
    model = Model(words.hash[often])
    # The first input starts as the logarithm of the odds, so that training starts from what words say alone.
    model.p["word"][:-1, 0] = _odds(df[1][often], texts[1], df[0][often], texts[0])
    held_by = []
    for k in (0, 1):
        mine = label[doc] == k
        n = np.diff(words.ends)[word[mine]]
        at = np.repeat(words.ends[word[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique(np.repeat(doc[mine], n) * np.int64(GRAMS) + words.grams[at])
        held_by.append(np.bincount(both % GRAMS, minlength=GRAMS))
    model.p["gram"][:, 1] = _odds(held_by[1], texts[1], held_by[0], texts[0])
    trainer = Trainer(model, words)
    draw = np.random.default_rng(7)
    open_ = np.flatnonzero(~held[row])
    for turn in range(ROUNDS + 1):
        if turn == 0:
            place = draw.random(len(open_))
        else:
            place = -model.scores(model.inputs(words), places[open_])
        # Each text's windows by rank: the worst ones of toxic texts, the worst and some others of clean texts.
        by = np.lexsort((place, row[open_]))
        n_of = np.bincount(row[open_], minlength=len(label))
        rank = np.empty(len(open_), np.int64)
        rank[by] = np.arange(len(open_)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        toxic = label[row[open_]] == 1
        pick = (rank < np.where(toxic, 8 if turn == 0 else 2, 8 if turn == 0 else 3)) | (~toxic & (draw.random(len(open_)) < 0.1))
        chosen = open_[pick]
        kind = label[row[chosen]]
        weight = np.where(kind == 1, 0.5 / max(1, (kind == 1).sum()), 0.5 / max(1, (kind == 0).sum()))
        for _ in range(1 if turn == 0 else 2):
            draw_order = draw.permutation(len(chosen))
            for s in range(0, len(chosen), BATCH):
                at = draw_order[s:s + BATCH]
                trainer.step(places[chosen[at]], kind[at], weight[at])
    # The curve from a text's score to its probability.
    check = np.flatnonzero(held[row]) if held.any() and len(set(label[held])) == 2 else np.arange(len(row))
    best = np.full(len(label), -np.inf)
    np.maximum.at(best, row[check], model.scores(model.inputs(words), places[check]))
    mine = np.isfinite(best)
    x, y = best[mine], label[mine].astype(float)
    smooth = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * x + shift, -40, 40)))
        d = q * (1 - q) + 1e-9
        g = np.array([((q - smooth) * x).sum() + 1e-3 * (slope - 1), (q - smooth).sum()])
        hess = np.array([[(d * x * x).sum() + 1e-3, (d * x).sum()], [(d * x).sum(), d.sum()]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -3, 3)
    model.slope, model.shift = float(max(slope, 0.05)), float(shift)
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        table = pa.Table.from_batches(held).sort_by("order")
        label = np.asarray(table["label"]).astype(np.int64)
        if label.min() != label.max():
            model = fit(common.text_column(table["text"]), label, np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return id_mod(key, HELD_PARTS) == HELD


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model | float:
    """A model of at most ``sample`` texts of either label, chosen by a hash of the key.

    ``docs`` are the rows that may be learnt from. If one label is missing, its share (0.0 or 1.0) stands for the model.
    """
    need(docs, text, key)
    need(labels, key, label)
    common.lean_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) != 0).cast("int")).alias("label"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    order = F.xxhash64(F.col("key").cast("string"), F.lit(13))
    # Only rows of both tables count, so keys are joined before they are sampled, and texts come last.
    both = known.join(rows.select("key"), "key", "left_semi")
    chosen = None
    for kind in (0, 1):
        some = both.where(F.col("label") == kind).orderBy(order, "key").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = rows.join(F.broadcast(chosen), "key").withColumn("order", order)  # at most twice the sample
    texts = texts.orderBy("order", "key").limit(2 * sample)
    found = texts.select("text", "label", "order").repartition(1).mapInArrow(_fitted, "model binary").collect()
    if found:
        return pickle.loads(found[0]["model"])
    return float(known.where("label = 1").join(rows.select("key"), "key", "left_semi").limit(1).count())


def _scored(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | float = sent.value
        for batch in batches:
            column = common.text_column(batch.column("text"))
            out = np.zeros(len(column))
            if isinstance(model, float):
                out[:] = model
            else:
                for a, b, data, offsets in common.text_blocks(column):
                    starts, ends, rows = common.word_spans(data, offsets, OUTSIDE)
                    words = Words(data, starts, ends)
                    count = np.bincount(rows, minlength=b - a)
                    x = model.inputs(words)
                    row, first, size = _windows(count)
                    first += (np.cumsum(count) - count)[row]
                    worst = np.full(b - a, -np.inf)
                    for s in range(0, len(row), CHUNK):
                        part = slice(s, s + CHUNK)
                        np.maximum.at(worst, row[part], model.scores(x, _places(first[part], size[part], words.of, len(words.hash))))
                    out[a:b] = model.probability(worst)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held"), pa.array(out)], names=["key", "held", "score"])

    return score


def score(docs: DataFrame, model: Model | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) for every row: all overlapping windows of the whole text.

    Null and empty texts, and texts of spaces, are one empty window. Repeated rows get equal scores; keys may be null.
    A text of any length is scored whole. Other columns are ignored.
    """
    need(docs, text, key)
    spark = docs.sparkSession
    common.lean_batches(spark)
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held"), F.col(text).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scored(sent), f"key {docs.schema[key].dataType.simpleString()}, held boolean, score double")
    return scored.select(F.col("key").alias(key), F.col("held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
