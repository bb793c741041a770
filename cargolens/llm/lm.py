"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Symbols are the most common words, classes of all other words by their first bytes, and the end of a text.
A position's context vector is the sum of the vectors of the symbols before it, weighted per distance; its
product with all symbols' vectors, normalised, gives the symbol's probability. A word inside a class has its share of the class's training
tokens, and all words that training never saw share half a token, so probabilities of all words add up to one.
Every partition of the training rows trains a copy in one pass; copies are averaged by their tokens. Exact counts of common words are kept in a bounded table; those of all others come from
one shuffle by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm import common
from cargolens.llm.common import id_mod, need
from cargolens.session import cut

#: Bounds of the tables that every task holds, whatever the input: common words, own symbols, classes.
HEAD, OWN, CLASSES = 1 << 17, 320, 64
DIM, CONTEXT = 24, 5
#: Positions per step, noise words per step (shared by its positions), step size.
STEP, NOISE, RATE = 4096, 64, 0.15
SLICES, LANES = 16, 64
HELD_PARTS, HELD = 5, 1
LN10 = np.log(10.0)


@dataclass
class Vocabulary:
    """Common words by hash, with the symbol of each; the class of every pair of first bytes."""

    words: np.ndarray
    symbol: np.ndarray
    class_of: np.ndarray
    expected: np.ndarray  # about how often each symbol occurs: the noise

    @property
    def own(self) -> int:
        return OWN

    end = OWN + CLASSES
    size = OWN + CLASSES + 1


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each word, hash, first two bytes) of runs of rows."""
    for a, b, data, offsets in common.text_blocks(column):
        starts, ends, rows = common.word_spans(data, offsets)
        folded = common.FOLD_CASE[data]
        second = np.where(ends - starts > 1, folded[np.minimum(starts + 1, max(0, len(folded) - 1))], 0) if len(starts) else starts
        first = folded[starts].astype(np.uint16) | (second.astype(np.uint16) << np.uint16(8))
        yield a, b - a, rows, common.word_hashes(data, starts, ends, fold=True), first


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition that may be common: only a word at or above the share of the last common one can be."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = texts = pending = 0

    def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, f, n = (np.concatenate(x) for x in zip(*held))
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        return u, f[at], np.bincount(back, n, minlength=len(u)).astype(np.int64)

    for batch in batches:
        for _, n_rows, _, h, first in _tokens(common.text_column(batch.column(0))):
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, first[at], n))
            pending += len(u)
            total += len(h)
            texts += n_rows
            if pending > 4_000_000:
                held = [fold()]
                pending = len(held[0][0]) // 2
    if held:
        h, f, n = fold()
        use = n * 4 * HEAD >= total
        yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(f[use].astype(np.int32)), pa.array(n[use])],
                                         names=["h", "first", "n"])


def vocabulary(train: DataFrame, text: str) -> Vocabulary:
    rows = train.select(F.col(text).cast("string").alias("text")).mapInArrow(_common, "h bigint, first int, n bigint")
    # The least count of a common word is read from a small histogram, 64 steps to an octave; nothing is ranked.
    level = F.floor(F.log2("n") * 64).cast("int")
    counted = cut(rows.groupBy("h").agg(F.first("first").alias("first"), F.sum("n").alias("n")).withColumn("level", level))
    least, words = None, 0
    for row in sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):  # a few thousand levels at most
        words += row["words"]
        if words > HEAD:
            break
        least = row["level"]
    top = counted.where(F.col("level") >= (1 << 30 if least is None else least)).select("h", "first", "n").toArrow()  # at most HEAD words
    h, first, n = (np.asarray(top[c].combine_chunks()) for c in ("h", "first", "n"))
    order = np.lexsort((h, -n))
    h, first, n = h[order], first[order], n[order]
    tokens = np.bincount(first[OWN:], n[OWN:], minlength=1 << 16)
    ranked = [int(i) for i in np.lexsort((np.arange(1 << 16), -tokens)) if tokens[i] > 0][:CLASSES - 1]
    class_of = np.full(1 << 16, CLASSES - 1, np.int16)
    class_of[ranked] = np.arange(len(ranked))
    symbol = (OWN + class_of[first]).astype(np.int16)
    symbol[:OWN] = np.arange(min(OWN, len(h)))
    expected = np.bincount(symbol, n, minlength=Vocabulary.size).astype(np.float64) + 1
    expected[Vocabulary.end] += max(1.0, n.sum() / 300)
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], symbol[order], class_of, expected / expected.sum())


def _symbols(v: Vocabulary, n_rows: int, rows: np.ndarray, h: np.ndarray, first: np.ndarray):
    """(place among common words or -1, symbols with text ends, places of the real symbols).

    Every text is preceded by CONTEXT begin marks, so contexts never reach into the text before.
    """
    at = np.searchsorted(v.words, h)
    at[at == len(v.words)] = 0
    known = v.words[at] == h if len(v.words) else np.zeros(len(h), bool)
    place = np.where(known, at, -1)
    symbol = np.where(known, v.symbol[at] if len(v.words) else 0, OWN + v.class_of[first])
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count + CONTEXT + 1) - (count + 1)
    flat = np.full(int((count + CONTEXT + 1).sum()), v.size, np.int16)
    flat[begin[rows] + np.arange(len(rows)) - (np.cumsum(count) - count)[rows]] = symbol
    flat[begin + count] = v.end
    return place, symbol, flat, np.flatnonzero(flat != v.size), count


class Model:
    """Vectors of symbols as context and as target, weights per distance, biases; one flat array holds all."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        n = v.size
        shapes = [(n + 1, DIM), (n, DIM), (CONTEXT, DIM), (n,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        if flat is None:
            draw = np.random.default_rng(1)
            flat = np.concatenate([draw.normal(0, 0.1, ends[1]), np.ones(CONTEXT * DIM), np.log(v.expected)])
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, ends[:-1])
        self.context, self.target, self.weight, self.bias = (p.reshape(s) for p, s in zip(parts, shapes))

    def hidden(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.context[flat[at - 1]] * self.weight[0]
        for j in range(1, CONTEXT):
            out += self.context[flat[at - 1 - j]] * self.weight[j]
        return out

    def log10(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the symbols at ``at``, by batched matrix products."""
        out = np.empty(len(at))
        ones = np.ones(len(self.target), np.float32)
        for s in range(0, len(at), 2048):
            where = at[s:s + 2048]
            score = self.hidden(flat, where) @ self.target.T
            score += self.bias
            own = score[np.arange(len(where)), flat[where]].astype(np.float64)
            high = max(0.0, float(score.max()) - 60)
            if high:
                score -= np.float32(high)
            np.exp(score, out=score)
            out[s:s + 2048] = (own - high - np.log((score @ ones).astype(np.float64))) / LN10
        return out


def _spread(rows: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """Add rows of ``values`` to the rows of ``into``."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    into[rows[first]] += np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes."""

    def __init__(self, v: Vocabulary, seed: int):
        self.model = Model(v)
        self.square = np.full(len(self.model.flat), 1e-6, np.float32)
        self.draw = np.random.default_rng(seed)
        self.cum = np.cumsum(v.expected)
        self.offset = (np.log(v.expected) + np.log(NOISE)).astype(np.float32)
        self.grad = Model(v, np.zeros(len(self.model.flat)))

    def step(self, flat: np.ndarray, at: np.ndarray) -> None:
        m, g = self.model, self.grad
        w = flat[at]
        hidden = m.hidden(flat, at)
        noise = np.minimum(np.searchsorted(self.cum, self.draw.random(NOISE)), len(self.cum) - 1).astype(np.int16)
        good = (hidden * m.target[w]).sum(axis=1) + m.bias[w] - self.offset[w]
        bad = hidden @ m.target[noise].T + (m.bias[noise] - self.offset[noise])
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        g.flat[:] = 0
        to_hidden = up[:, None] * m.target[w] + down @ m.target[noise]
        _spread(np.concatenate([w, noise]), np.concatenate([up[:, None] * hidden, down.T @ hidden]), g.target)
        g.bias += np.bincount(w, up, minlength=len(g.bias)).astype(np.float32)
        g.bias += np.bincount(noise, down.sum(axis=0), minlength=len(g.bias)).astype(np.float32)
        parts, who = [], []
        for j in range(CONTEXT):
            before = flat[at - 1 - j]
            g.weight[j] = (to_hidden * m.context[before]).sum(axis=0)
            parts.append(to_hidden * m.weight[j])
            who.append(before)
        _spread(np.concatenate(who), np.concatenate(parts), g.context)
        g.flat /= len(at)
        self.square += g.flat * g.flat
        m.flat += RATE * g.flat / np.sqrt(self.square)


def _trained(sent):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        part = TaskContext.get().partitionId()
        trainer = Trainer(v, part)
        head, cls, texts, tokens = np.zeros(len(v.words)), np.zeros(CLASSES), 0, 0
        rest_flat, rest_at = np.zeros(0, np.int16), np.zeros(0, np.int64)
        for batch in batches:
            for _, n_rows, rows, h, first in _tokens(common.text_column(batch.column(0))):
                place, symbol, flat, at, _ = _symbols(v, n_rows, rows, h, first)
                head += np.bincount(place[place >= 0], minlength=len(head))
                cls += np.bincount(symbol[symbol >= OWN] - OWN, minlength=CLASSES)
                texts += n_rows
                tokens += len(at)
                # What doesn't fill a step waits for the next rows.
                at = np.concatenate([rest_at, at + len(rest_flat)])
                flat = np.concatenate([rest_flat, flat])
                full = len(at) // STEP * STEP
                for s in range(0, full, STEP):
                    trainer.step(flat, at[s:s + STEP])
                keep = at[full] - CONTEXT if full < len(at) else len(flat)
                rest_flat, rest_at = flat[keep:], at[full:] - keep
        if len(rest_at):
            trainer.step(rest_flat, rest_at)
        if tokens:
            whole = np.concatenate([[texts, tokens], cls, head, trainer.model.flat.astype(np.float64) * tokens])
            pieces = np.array_split(whole, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part % LANES] * SLICES, pa.int32()),
                                              pa.array([x.tobytes() for x in pieces], pa.binary())], names=["slice", "lane", "sums"])

    return train


def _summed(table: pa.Table) -> pa.Table:
    total = None
    for blob in table["sums"]:
        x = np.frombuffer(blob.as_py())
        total = x.copy() if total is None else total + x
    return pa.table([table["slice"][:1], table["lane"][:1], pa.array([total.tobytes()], pa.binary())], names=["slice", "lane", "sums"])


@dataclass
class Scorer:
    vocabulary: Vocabulary
    parameters: np.ndarray
    counts: np.ndarray  # of the common words
    class_tokens: np.ndarray
    texts: int
    tokens: int


def learn(train: DataFrame, text: str = "text") -> Scorer:
    """Train on every row of ``train``; nulls are empty texts. What comes to the driver has a fixed size."""
    v = vocabulary(train, text)
    sent = train.sparkSession.sparkContext.broadcast(v)
    kind = "slice int, lane int, sums binary"
    parts = train.select(F.col(text).cast("string").alias("text")).mapInArrow(_trained(sent), kind)
    lanes = parts.groupBy("slice", "lane").applyInArrow(_summed, kind)
    found = lanes.groupBy("slice").applyInArrow(_summed, kind).toArrow().sort_by("slice")
    if not found.num_rows:
        return Scorer(v, Model(v).flat, np.zeros(0), np.zeros(CLASSES), 0, 0)
    whole = np.concatenate([np.frombuffer(x.as_py()) for x in found["sums"]])
    texts, tokens = int(whole[0]), int(whole[1])
    cls, head, flat = np.split(whole[2:], [CLASSES, CLASSES + len(v.words)])
    return Scorer(v, (flat / tokens).astype(np.float32), head, cls, texts, tokens)


def _scored(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = sent.value
        v, model = s.vocabulary, Model(s.vocabulary, s.parameters)
        plus_half = np.log10(s.counts + 0.5) if len(s.counts) else np.zeros(1)
        in_class = np.log10(np.maximum(s.counts, 0.5)) if len(s.counts) else np.zeros(1)
        class_log = np.log10(s.class_tokens + 0.5)
        seen = s.counts > 0 if len(s.counts) else np.zeros(1, bool)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            column = common.text_column(batch.column("text"))
            n = len(column)
            tokens, known, base, own = (np.zeros(n) for _ in range(4))
            lists = []
            for a, n_rows, rows, h, first in _tokens(column):
                place, symbol, flat, at, count = _symbols(v, n_rows, rows, h, first)
                b = a + n_rows
                here = lambda who, x: np.bincount(who, x, minlength=n_rows)
                who = np.repeat(np.arange(n_rows), count + 1)
                own[a:b] = here(who, model.log10(flat, at))
                tokens[a:b] = count + 1
                head = place >= 0
                base[a:b] = here(rows[head], plus_half[place[head]]) + np.log10(s.texts + 0.5)
                known[a:b] = here(rows[head], seen[place[head]]) + (s.texts > 0)
                inner = symbol >= OWN
                within = np.where(head, in_class[place], 0) - class_log[np.where(inner, symbol - OWN, 0)]
                own[a:b] += here(rows[inner], within[inner])
                tail, tail_row = h[~head], rows[~head]
                order = np.lexsort((tail, tail_row))
                tail, tail_row = tail[order], tail_row[order]
                new = np.ones(len(tail), bool)
                new[1:] = (tail[1:] != tail[:-1]) | (tail_row[1:] != tail_row[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(tail)))
                lists.append((common.list_array(tail[new].view(np.int64), tail_row[new], n_rows, pa.int64()),
                              common.list_array(times.astype(np.int32), tail_row[new], n_rows, pa.int32())))
            words, times = (pa.concat_arrays(x) for x in zip(*lists)) if lists else (pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), batch.column("key"), batch.column("train"), pa.array(tokens.astype(np.int64)),
                pa.array(known.astype(np.int64)), pa.array(base), pa.array(own), words, times],
                names=["row", "key", "train", "tokens", "known", "base", "own", "words", "times"])
            row += n

    return score


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of all rows by a model of the rows whose crc32(key) mod 5 is not 1.

    (key, held_out, n_tokens, n_known, train_tokens, base_score, score): see the contract of the query. Null and
    empty texts are one end token. Repeated rows are scored and learnt from one by one. Without training rows all
    counts are 0 and probabilities uniform. Other columns are ignored.
    """
    need(docs, text, key)
    spark = docs.sparkSession
    common.lean_batches(spark)
    train = id_mod(key, HELD_PARTS) != HELD
    scorer = learn(docs.where(train), text)
    sent = spark.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(key).alias("key"), train.alias("train"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    scored = cut(rows.mapInArrow(_scored(sent), f"row bigint, key {kind}, train boolean, tokens bigint, known bigint, base double, own double, "
                                                "words array<bigint>, times array<int>"))
    # Words beyond the common ones: one shuffle by word gives each its training count. The common ones took
    # every word with a large share away, so no word here is hot.
    each = scored.select("row", "train", F.inline(F.arrays_zip("words", "times"))).toDF("row", "train", "word", "times")
    by_word = W.partitionBy("word")
    each = each.withColumn("c", F.sum(F.when(F.col("train"), F.col("times")).otherwise(0)).over(by_word)) \
        .withColumn("first", (F.row_number().over(by_word.orderBy("row")) == 1) & (F.col("c") > 0))
    c = F.col("c")
    tail = cut(each.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("t_base"), F.sum(F.col("times") * F.log10(F.greatest(c, F.lit(0.5)))).alias("t_own"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("t_known"), F.sum(F.col("first").cast("int")).alias("t_first")))
    distinct = int((scorer.counts > 0).sum()) + (scorer.texts > 0) + (tail.agg(F.sum("t_first")).first()[0] or 0)
    n = scorer.tokens
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.select("row", "key", "train", "tokens", "known", "base", "own").join(tail, "row", "left").select(
        F.col("key").alias(key), (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), (F.col("known") + zero("t_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") - F.col("tokens") * float(np.log10(n + 0.5 * (distinct + 1)))).alias("base_score"),
        (F.col("own") + zero("t_own")).alias("score"))
