"""Phrase collocations: exact counts from a HAT-trie per task, merged per prefix partition.

Phrases are counted size by size. A task keeps those of its rows in a trie over word ids: inner nodes cut the
prefix space into ranges, the leaves are hash containers that burst into two when they grow. When the trie has
reached its bound, its largest subtrees leave as sorted runs, one per prefix slot, and Spark's shuffle brings the
runs of a slot together, where they are merged. A prefix is the first word; below very common words, whose
subtrees would be large, it goes on to the second and third. A phrase is counted only if the phrases one word
shorter at both of its ends are frequent, which a bitmap of fixed size tells; what it lets through in error only
costs time. Words are told apart by 64-bit ids of language and word; should two ever share one, ids are drawn anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm import common
from cargolens.llm.common import mix, need, whole_groups
from cargolens.session import cut, num_shuffle_partitions

UNKNOWN = "und"
LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one that holds it has this share of its count, in per cent.
COVERED = 50
SCALE = 1_000_000
#: Entries of a task's trie, entries at which a container bursts, words of the input per prefix slot.
TRIE, BURST, PER_SLOT = 1 << 20, 1 << 15, 1 << 20
#: Bits of the bitmap of frequent phrases; most common words with subtrees of their own.
BITS, HEADS = 1 << 26, 1 << 16

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[32, 9]] = True


def _lang_seed(lang: str, salt: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{salt}|{lang}".encode(), digest_size=8).digest(), "little"))


def _words(batch: pa.RecordBatch, salt: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, word ids, piece of each word, folded bytes, starts, ends) of blocks of rows of one language."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        seed = _lang_seed(lang, salt)
        column = common.text_column(batch.column("text").filter(pc.equal(langs, lang)))
        for _, _, data, offsets in common.text_blocks(column):
            starts, ends, rows = common.word_spans(data, offsets, IS_GAP)
            if len(starts):
                ids = mix(common.word_hashes(data, starts, ends, fold=True) ^ seed)
                piece = np.cumsum(IS_BREAK[data])[starts] + rows
                yield lang, ids, piece, common.FOLD_CASE[data], starts, ends


def _counted_words(salt: int):
    """Words of a partition with their texts and counts; a full dictionary is passed on and begun anew."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        entries = 0

        def fold() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = np.asarray(table["id"]).view(np.uint64)
            _, at, back = np.unique(ids, return_index=True, return_inverse=True)
            n = np.bincount(back, np.asarray(table["n"]), minlength=len(at)).astype(np.int64)
            kept = table.take(pa.array(at)).set_column(3, "n", pa.array(n)).combine_chunks()
            return kept.to_batches()[0]

        for batch in batches:
            for lang, ids, _, data, starts, ends in _words(batch, salt):
                u, at, n = np.unique(ids, return_index=True, return_counts=True)
                held.append(pa.RecordBatch.from_arrays([
                    pa.array(u.view(np.int64)), pa.array([lang] * len(u), pa.string()),
                    common.slices(data, starts[at], ends[at]).cast(pa.binary()), pa.array(n.astype(np.int64))], names=["id", "lang", "word", "n"]))
                entries += len(u)
                if entries > TRIE:
                    whole = fold()
                    held, entries = ([], 0) if len(whole) > TRIE // 2 else ([whole], len(whole))
                    if not held:
                        yield whole
        if held:
            yield fold()

    return count


class Grams:
    """Phrases of one size with counts: hash, slot, words and count as columns."""

    def __init__(self, h: np.ndarray, slot: np.ndarray, words: np.ndarray, n: np.ndarray):
        self.h, self.slot, self.words, self.n = h, slot, words, n

    def __len__(self) -> int:
        return len(self.h)

    def pick(self, at) -> Grams:
        return Grams(self.h[at], self.slot[at], self.words[at], self.n[at])

    @staticmethod
    def merged(parts: list[Grams]) -> Grams:
        """Equal phrases become one. They are sorted by hash; where two phrases share a hash, by their words too."""
        h, slot, words, n = (np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "slot", "words", "n"))
        order = np.argsort(h)
        s, w = h[order], words[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if ((w[1:] != w[:-1]).any(axis=1) & ~new[1:]).any():
            order = np.lexsort((*words.T, h))
            w = words[order]
            new[1:] = (w[1:] != w[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        return Grams(h[order[first]], slot[order[first]], w[first], np.add.reduceat(n[order], first) if len(first) else n)


class Container:
    """Phrases whose slots lie in a range, as rows in order of their hash, and what was added since."""

    def __init__(self, low: int, high: int, parts: list[Grams]):
        self.low, self.high, self.parts = low, high, parts
        self.size, self.folded = sum(len(p) for p in parts), 0

    def add(self, grams: Grams) -> None:
        self.parts.append(grams)
        self.size += len(grams)
        if self.size > 2 * self.folded + 4096:
            self.fold()

    def fold(self) -> None:
        if len(self.parts) > 1 or not self.folded:
            self.parts = [Grams.merged(self.parts)]
        self.size = self.folded = len(self.parts[0])

    def burst(self) -> list[Container]:
        """Two containers, each for half of the range."""
        self.fold()
        middle, all_ = (self.low + self.high) // 2, self.parts[0]
        left = all_.slot < middle
        out = [Container(self.low, middle, [all_.pick(left)]), Container(middle, self.high, [all_.pick(~left)])]
        for c in out:
            c.folded = c.size
        return out


class Trie:
    """Containers over ranges of prefix slots; ``add`` returns the subtrees that had to leave, as runs."""

    def __init__(self, slots: int):
        self.leaves = [Container(0, slots, [])]
        self.lows = np.zeros(1, np.int64)

    def add(self, grams: Grams) -> Iterator[Container]:
        at = np.searchsorted(self.lows, grams.slot, "right") - 1
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(self.leaves) + 1))
        grown = False
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if b > a:
                self.leaves[i].add(grams.pick(order[a:b]))
                grown |= self.leaves[i].folded > BURST and self.leaves[i].high - self.leaves[i].low > 1
        if grown:
            out = []
            for leaf in self.leaves:
                out += leaf.burst() if leaf.folded > BURST and leaf.high - leaf.low > 1 else [leaf]
            self.leaves, self.lows = out, np.array([c.low for c in out])
        total = sum(c.size for c in self.leaves)
        if total > TRIE:
            for leaf in sorted(self.leaves, key=lambda c: -c.size):
                if total <= TRIE // 2:
                    break
                total -= leaf.size
                leaf.fold()
                yield leaf
                self.leaves[self.leaves.index(leaf)] = Container(leaf.low, leaf.high, [])


def _run(leaf: Container) -> Iterator[pa.RecordBatch]:
    """A subtree as one row per slot: words and counts, sorted by words."""
    g = leaf.parts[0]
    g = g.pick(np.lexsort((*g.words.T[::-1], g.slot)))
    slots, first = np.unique(g.slot, return_index=True)
    ends = np.append(first, len(g)).astype(np.int32)
    width = g.words.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(slots.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends * np.int32(width)), pa.array(g.words.ravel().view(np.int64))),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(g.n))], names=["slot", "words", "n"])


def _hashed(words: np.ndarray) -> np.ndarray:
    """One hash per row of word ids; that of a single word is its id."""
    h = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k))
    return h


def _is_in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _slot(words: np.ndarray, heads: np.ndarray, slots: int) -> np.ndarray:
    """The slot of the prefix: the first word, and the next ones as long as all before are very common."""
    x = mix(words[:, 0] + np.uint64(1))
    on = np.ones(len(words), bool)
    for k in range(1, words.shape[1]):
        if len(heads):
            at = np.minimum(np.searchsorted(heads, words[:, k - 1]), len(heads) - 1)
            on &= heads[at] == words[:, k - 1]
        else:
            on[:] = False
        x = np.where(on, mix(x + words[:, k]), x)
    return ((x >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _counted(sent, size: int, salt: int, slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heads = sent.value
        trie = Trie(slots)
        for batch in batches:
            for _, ids, piece, _, _, _ in _words(batch, salt):
                n = len(ids) - size + 1
                if n <= 0:
                    continue
                shorter = _is_in(bits, _hashed(np.stack([ids[k:n + 1 + k] for k in range(size - 1)], axis=1)))
                at = np.flatnonzero((piece[:n] == piece[size - 1:]) & shorter[:-1] & shorter[1:])
                if len(at):
                    words = np.stack([ids[at + k] for k in range(size)], axis=1)
                    grams = Grams.merged([Grams(_hashed(words), _slot(words, heads, slots), words, np.ones(len(at), np.int64))])
                    for leaf in trie.add(grams):
                        yield from _run(leaf)
        for leaf in trie.leaves:
            if leaf.size:
                leaf.fold()
                yield from _run(leaf)

    return count


def _joined(size: int, least: int):
    """Runs of a slot merged; phrases below the least count end here."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, "slot"):
            for s, e in zip(at[:-1], at[1:]):
                part = table.slice(s, e - s)
                words = np.asarray(pc.list_flatten(part["words"]).combine_chunks()).view(np.uint64).reshape(-1, size)
                n = np.asarray(pc.list_flatten(part["n"]).combine_chunks())
                g = Grams.merged([Grams(_hashed(words), np.zeros(len(n), np.int64), words, n)])
                g = g.pick(g.n >= least)
                ends = np.arange(len(g) + 1, dtype=np.int32) * np.int32(size)
                yield pa.RecordBatch.from_arrays([pa.array(g.h.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.words.ravel().view(np.int64))),
                                                  pa.array(g.n)], names=["h", "words", "n"])

    return merge


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit per hash of a frequent phrase. At most BITS / 64 numbers come to the driver, whatever the input."""
    at = F.col("h").bitwiseAND(BITS - 1)
    found = frequent.groupBy(F.shiftright(at, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[np.asarray(found["at"])] = np.asarray(found["bits"]).view(np.uint64)
    return bits


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """(id, lang, word, n) of all words, and the salt of the ids."""
    rows = _rows(docs, text, lang)
    for salt in range(8):
        found = cut(rows.mapInArrow(_counted_words(salt), "id bigint, lang string, word binary, n bigint").groupBy("id").agg(
            F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"),
            ((F.min("word") != F.max("word")) | (F.min("lang") != F.max("lang"))).alias("clash")))
        if found.where("clash").isEmpty():
            return found.drop("clash").withColumn("word", F.col("word").cast("string")), salt
    raise RuntimeError("word ids clash under every salt")


def count_phrases(docs: DataFrame, words: DataFrame, salt: int, text: str = "text", lang: str = "lang",
                  least: int = LEAST, longest: int = LONGEST) -> dict[int, DataFrame]:
    """By size: (h, words, n) of the phrases with at least ``least`` occurrences; ``words`` are ids."""
    spark: SparkSession = docs.sparkSession
    common.lean_batches(spark)
    total = words.agg(F.sum("n")).first()[0] or 0
    slots = max(1, -(-total // PER_SLOT))
    common_from = max(PER_SLOT // 8, -(-total // HEADS))  # at most HEADS words are that common
    heads = np.sort(np.asarray(words.where(F.col("n") >= common_from).select("id").toArrow()["id"].combine_chunks()).view(np.uint64))
    rows, parts = _rows(docs, text, lang), num_shuffle_partitions(spark)
    out = {1: cut(words.where(F.col("n") >= least).select(F.col("id").alias("h"), F.array("id").alias("words"), "n"))}
    for size in range(2, longest + 1):
        sent = spark.sparkContext.broadcast((_bitmap(out[size - 1]), heads))
        runs = rows.mapInArrow(_counted(sent, size, salt, slots), "slot bigint, words array<bigint>, n array<bigint>")
        out[size] = cut(runs.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(_joined(size, least), "h bigint, words array<bigint>, n bigint"))
    return out


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
         covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    a, l and r count the phrase and its parts at the cut with the lowest score, n all words of the language. Null
    texts are empty, a null language is ``und`` and one with that label. Repeated rows count as often as they occur,
    texts of any length are counted whole. An empty table, or one without frequent phrases, gives no rows. Other columns are ignored.
    """
    need(docs, text, lang)
    common.lean_batches(docs.sparkSession)
    words, salt = count_words(docs, text, lang)
    grams = count_phrases(docs, words, salt, text, lang, least, longest)
    known = cut(words.where(F.col("n") >= least))
    parts = cut(_union([grams[k].select("words", "n") for k in range(1, longest)]))
    found = None
    for size in range(2, longest + 1):
        mine_ = grams[size].select("words", F.col("n").alias("a"))
        for k in range(1, size):
            cutting = mine_.select("words", F.slice("words", 1, k).alias("left"), F.slice("words", k + 1, size - k).alias("right"))
            cutting = cutting.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left") \
                .join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right").select("words", F.struct("l", "r").alias(f"cut{k}"))
            mine_ = mine_.join(cutting, "words")
        exact = "CAST(CAST({0} * CAST(a AS DECIMAL(38,0)) * a AS DECIMAL(38,0)) div (CAST(cut{1}.l AS DECIMAL(19,0)) * CAST(cut{1}.r AS DECIMAL(19,0))) AS BIGINT)"
        options = F.array(*[F.struct(F.expr(exact.format(SCALE, k)).alias("score"), F.lit(k).alias("k"), f"cut{k}.l", f"cut{k}.r") for k in range(1, size)])
        best = mine_.select("words", "a", F.array_min(options).alias("best")).select("words", "a", "best.l", "best.r", "best.score")
        found = best if found is None else found.unionByName(best)
    # Phrases inside a longer one that is nearly as frequent go.
    inner = [grams[size].select(F.slice("words", i, k).alias("words"), F.col("n").alias("longer"))
             for size in range(3, longest + 1) for k in range(2, size) for i in range(1, size - k + 2)]
    if inner:
        most = _union(inner).groupBy("words").agg(F.max("longer").alias("longer"))
        found = found.join(most, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    texts = found
    for k in range(longest):
        word = known.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 0 else []))
        texts = texts.withColumn(f"id{k}", F.get("words", F.lit(k))).join(word, f"id{k}", "inner" if k < 2 else "left")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = texts.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(longest)]).alias("phrase"), "a", "l", "r", "score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(cut(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
