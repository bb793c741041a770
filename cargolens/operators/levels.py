"""Trees of a key with more rows than one task takes: all tasks grow them together, level by level, from all rows.

Rows are dealt to blocks by a hash and stay where they lie, as bytes; a task holds one block at a time. In a round every task
adds up the histograms of its blocks over the nodes of the level. Splits are chosen from the sums, of boosted trees on the driver,
of forests by tree in tasks, and only the splits go out again.

Draws follow tree and block, sums are exact (whole numbers, or multiples of a power of two) and blocks follow row values, so
trees do not depend on how rows are dealt to partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; trees of a forest whose histograms are added up in one round.
BLOCK, TOGETHER = 1 << 15, 50
#: Partitions whose sums come to the driver without meeting in tasks first.
DIRECT = 64
#: Whole numbers below this are held in pairs by one double.
PAIRED = float(1 << 26)
#: How often a row is drawn, by 16 random bits: a Poisson number of mean 1.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


# --- Blocks ------------------------------------------------------------------------------


def _coded(a: np.ndarray) -> tuple[np.ndarray | None, bytes]:
    """Few different values as a table and bytes, others as they are."""
    values, at = np.unique(a, return_inverse=True)
    return (values, at.astype(np.uint8).tobytes()) if len(values) <= 256 else (None, a.tobytes())


def _plain(coded: tuple[np.ndarray | None, bytes]) -> np.ndarray:
    table, held = coded
    return np.frombuffer(held) if table is None else table[np.frombuffer(held, np.uint8)]


@dataclass
class Block:
    key: str
    number: int
    x: bytes
    y: tuple
    w: tuple
    now: np.ndarray | None = None  # what boosted trees say so far

    def bins(self, wide: int) -> np.ndarray:
        """Bins by feature."""
        return np.frombuffer(self.x, np.uint8).reshape(wide, -1)

    def seed(self, *more: int) -> list[int]:
        return [*more, zlib.crc32(self.key.encode()), self.number]


def _packed(wide: int):
    """Rows that come sorted by key and block as bytes by feature."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mine = None

        def whole() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                x = np.frombuffer(b"".join(t["x"].to_pylist()), np.uint8).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mine[0]]), pa.array([mine[1]], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary()),
                     *[pa.array([np.asarray(t[c], dtype=float).tobytes()], pa.binary()) for c in ("y", "w")]], names=["key", "block", "x", "y", "w"])

        for batch in batches:
            keys, numbers = batch.column("key").dictionary_encode(), np.asarray(batch.column("block"))
            names, codes = keys.dictionary.to_pylist(), np.asarray(keys.indices)
            starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(numbers, prepend=-1) != 0))
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                this = names[codes[a]], int(numbers[a])
                if this != mine:
                    yield from whole()
                    held, mine = [], this
                held.append(batch.slice(a, b - a))
        yield from whole()

    return pack


def blocks(rows: DataFrame, sizes: dict[str, int], wide: int) -> RDD:
    """Blocks of the keys in ``sizes``; ``rows`` has key, y, w, order (a hash of the row) and x."""
    spark = rows.sparkSession
    many = {k: -(-n // BLOCK) for k, n in sizes.items()}
    first = dict(zip(many, np.cumsum([0, *many.values()]).tolist()))
    parts = max(1, min(sum(many.values()), spark.sparkContext.defaultParallelism))
    each = lambda values: F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col("key"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("order", F.lit(2)), each(many)).cast("int")) \
        .repartitionById(parts, F.pmod(F.col("block") + each(first), F.lit(parts)).cast("int")).sortWithinPartitions("key", "block", "order")
    packed = dealt.select("key", "block", "y", "w", "x").mapInArrow(_packed(wide), "key string, block int, x binary, y binary, w binary").rdd
    return packed.map(lambda r: Block(r["key"], r["block"], bytes(r["x"]), _coded(np.frombuffer(r["y"])), _coded(np.frombuffer(r["w"]))))


# --- Trees -------------------------------------------------------------------------------


@dataclass
class Grown:
    """A tree in the making: its nodes breadth first, conditions by bins, and where its last level begins."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [255])
    child: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    first: int = 0

    @property
    def open(self) -> int:
        return len(self.feature) - self.first

    def split(self, found: list[tuple]) -> None:
        """Take up a level's splits: per node (feature, bin, gain, sums, sums on the left), the feature -1 for none."""
        level, self.first = self.first, len(self.feature)
        for i, (f, b, gain, sums, left) in enumerate(found, level):
            self.sums[i] = sums
            if f >= 0:
                self.feature[i], self.bin[i], self.child[i], self.gain[i] = f, b, len(self.feature), gain
                for part in (left, (sums[0] - left[0], sums[1] - left[1])):
                    self.child.append(len(self.feature))
                    self.feature.append(-1)
                    self.bin.append(255)
                    self.gain.append(0.0)
                    self.sums.append(part)

    def values(self, penalty: float) -> np.ndarray:
        g, h = np.array(self.sums).T
        return g / np.maximum(h + penalty, 1e-12)


class Walk:
    """The conditions of a tree as arrays."""

    def __init__(self, tree: Grown):
        self.feature = np.maximum(np.array(tree.feature), 0)
        self.bin, self.child, self.first = np.array(tree.bin), np.array(tree.child), tree.first

    def nodes(self, x: np.ndarray, steps: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The nodes that rows of ``x``, by feature, reach in so many steps."""
        n = x.shape[1]
        rows = np.arange(n) if rows is None else rows
        flat, at = x.ravel(), np.zeros(len(rows), np.int64)
        line = self.feature * n
        for _ in range(steps):
            at = self.child.take(at) + (flat.take(line.take(at) + rows) > self.bin.take(at))
        return at


def _best(hist: np.ndarray, features: np.ndarray, first: np.ndarray, bins: np.ndarray, sums: np.ndarray, penalty: float, least: float) -> list[tuple]:
    """The best split of every node. Line i of ``features`` has the features that node i looks at, in order, ``first`` where their bins begin in ``hist``."""
    wide, slots = features.shape
    best, split, left = np.full(wide, 1e-9), np.full((wide, 2), -1, np.int64), np.zeros((wide, 2))
    base = sums[0] ** 2 / np.maximum(sums[1] + penalty, 1e-12)
    for s in range(slots):
        for many in np.unique(bins[features[:, s]]):  # nodes whose features have equally many bins go together
            here = np.flatnonzero(bins[features[:, s]] == many)
            at = first[here, s][:, None] + np.arange(many - 1)
            left_g, left_h = hist[0][at].cumsum(axis=1), hist[1][at].cumsum(axis=1)
            right_g, right_h = sums[0][here, None] - left_g, sums[1][here, None] - left_h
            fits = (left_h >= least) & (right_h >= least)
            gain = np.where(fits, left_g ** 2 / np.maximum(left_h + penalty, 1e-12) + right_g ** 2 / np.maximum(right_h + penalty, 1e-12), -np.inf)
            gain -= base[here, None]
            b = np.argmax(gain, axis=1)
            line = np.arange(len(here))
            top = gain[line, b]
            better = top > best[here] + 1e-9 * np.abs(best[here])
            line, b, found = line[better], b[better], here[better]
            best[found] = top[better]
            split[found, 0], split[found, 1] = features[found, s], b
            left[found, 0], left[found, 1] = left_g[line, b], left_h[line, b]
    return [(int(f), int(b), float(v) if f >= 0 else 0.0, (float(g), float(h)), (float(a), float(c)))
            for (f, b), v, g, h, (a, c) in zip(split, best, sums[0], sums[1], left)]


def _table(key: str, number: int, tree: Grown, values: np.ndarray, edges: Sequence[np.ndarray]) -> pa.Table:
    n = len(tree.feature)
    threshold = [np.inf if f < 0 else float(edges[f][b - 1]) if b > 0 else -np.inf for f, b in zip(tree.feature, tree.bin)]
    return pa.table({
        "key": pa.array([key] * n, pa.string()), "tree": pa.array([number] * n, pa.int32()), "node": pa.array(np.arange(n), pa.int32()),
        "feature": pa.array(tree.feature, pa.int32()), "threshold": pa.array(threshold, pa.float64()), "child": pa.array(tree.child, pa.int32()),
        "value": pa.array(values, pa.float64()), "gain": pa.array(tree.gain, pa.float64()), "cover": pa.array([h for _, h in tree.sums], pa.float64())})


# --- Forests -----------------------------------------------------------------------------


class ForestRound:
    """Histograms of one level of some trees of every key, and the splits from them."""

    def __init__(self, plan, bins: np.ndarray, trees: dict[tuple[str, int], Grown], level: int, whole: bool):
        self.plan, self.bins, self.level, self.whole = plan, bins, level, whole
        self.walks = {k: Walk(t) for k, t in trees.items()}
        self.wide = {k: t.open for k, t in trees.items()}

    def looked(self, tree: tuple[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Features that every node looks at, where their bins begin, and the bins of all."""
        wide, n = self.wide[tree], len(self.bins)
        size = max(1, round(n ** 0.5))
        draw = np.random.default_rng((self.plan.seed, tree[1], self.level, 1))
        features = np.sort(np.argpartition(draw.random((wide, n)), size - 1, axis=1)[:, :size], axis=1)
        ends = np.cumsum(self.bins[features].ravel())
        return features, (ends - self.bins[features].ravel()).reshape(wide, size), int(ends[-1])

    def add(self, part: Iterator[Block]) -> Iterator[tuple]:
        looked = {k: self.looked(k) for k in self.walks}
        found: dict = {}
        for block in part:
            mine = [k for k in self.walks if k[0] == block.key]
            if not mine:
                continue
            x, y, w = block.bins(len(self.bins)), _plain(block.y), _plain(block.w)
            n, flat = x.shape[1], x.ravel()
            for k in mine:
                features, first, size = looked[k]
                walk = self.walks[k]
                draw = np.random.Generator(np.random.SFC64(block.seed(self.plan.seed, k[1])))
                often = DRAWN[draw.integers(0, 1 << 16, n, np.uint16)]
                rows = np.flatnonzero(often)
                place = walk.nodes(x, self.level, rows) - walk.first
                if walk.first and (place < 0).any():
                    rows, place = rows[place >= 0], place[place >= 0]
                h = often[rows] * w[rows]
                g = h * y[rows]
                at = flat.take((features * n).take(place, axis=0) + rows[:, None]) + first.take(place, axis=0)
                slots = at.shape[1]
                if self.whole:
                    sums = np.bincount(at.ravel(), np.repeat(h * PAIRED + g, slots), size)
                else:
                    sums = np.stack([np.bincount(at.ravel(), np.repeat(v, slots), size) for v in (g, h)])
                if k in found:
                    found[k] += sums
                else:
                    found[k] = sums
        for k, sums in found.items():
            if self.whole:
                high = np.floor(sums / PAIRED)
                sums = np.stack([sums - high * PAIRED, high])
                sums = sums.astype(np.min_scalar_type(int(sums.max())))
            yield k, sums

    def splits(self, item: tuple) -> tuple:
        k, hist = item
        features, first, _ = self.looked(k)
        hist = hist.astype(float)
        begin = first[:, 0]
        many = self.bins[features[:, 0]]
        total = np.concatenate([np.zeros((2, 1)), hist.cumsum(axis=1)], axis=1)
        sums = total[:, begin + many] - total[:, begin]
        return k, _best(hist, features, first, self.bins, sums, 0.0, 1e-12)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if a.dtype == float else a.astype(np.int64) + b


def forest(base: RDD, plan, edges: Sequence[np.ndarray], sizes: dict[str, int], whole: bool) -> Iterator[pa.Table]:
    bins = np.array([len(e) + 2 for e in edges])
    parts = base.getNumPartitions()
    step = max(1, TOGETHER // len(sizes))
    for a in range(0, plan.trees, step):
        trees = {(k, t): Grown() for k in sizes for t in range(a, min(plan.trees, a + step))}
        for level in range(plan.depth):
            open_ = {k: t for k, t in trees.items() if t.open}
            if not open_:
                break
            turn = ForestRound(plan, bins, open_, level, whole)
            for k, found in base.mapPartitions(turn.add).reduceByKey(_added, parts).map(turn.splits).collect():
                trees[k].split(found)
        for (key, t), tree in trees.items():
            yield _table(key, t, tree, tree.values(0.0), edges)


# --- Boosting ----------------------------------------------------------------------------


class BoostRound:
    """Histograms of one level of every key's tree; sums are whole numbers, the parts of a key's ``unit``."""

    def __init__(self, plan, bins: np.ndarray, columns: np.ndarray, trees: dict[str, Grown], number: int, level: int, units: dict[str, float]):
        self.plan, self.bins, self.columns, self.number, self.level, self.units = plan, bins, columns, number, level, units
        self.walks = {k: Walk(t) for k, t in trees.items()}
        self.wide = {k: t.open for k, t in trees.items()}
        self.ends = np.concatenate([[0], np.cumsum(bins[columns])])

    def add(self, part: Iterator[Block]) -> Iterator[tuple]:
        found: dict = {}
        for block in part:
            if block.key not in self.walks:
                continue
            x, y, w = block.bins(len(self.bins)), _plain(block.y), _plain(block.w)
            walk, wide, unit = self.walks[block.key], self.wide[block.key], self.units[block.key]
            if self.plan.kind == "logistic":
                p = 1 / (1 + np.exp(-block.now))
                g, h = w * (y - p), w * p * (1 - p)
            else:
                g, h = w * (y - block.now), w
            rows = None
            if self.plan.row_share < 1:
                rows = np.flatnonzero(np.random.default_rng(block.seed(self.plan.seed, self.number)).random(len(y)) < self.plan.row_share)
            place = walk.nodes(x, self.level, rows) - walk.first
            if walk.first and (place < 0).any():
                stays = place >= 0
                rows, place = np.flatnonzero(stays) if rows is None else rows[stays], place[stays]
            if rows is not None:
                g, h = g[rows], h[rows]
            g, h = np.rint(g * unit), np.rint(h * unit)
            sums = found.setdefault(block.key, np.zeros((2, wide * self.ends[-1])))
            room = np.empty(len(place), np.int64)
            for j, f in enumerate(self.columns):
                many = self.bins[f]
                at = np.add(place * many, x[f] if rows is None else x[f].take(rows), out=room)
                # A feature's bins of all nodes lie side by side.
                a, b = wide * self.ends[j], wide * self.ends[j + 1]
                sums[0, a:b] += np.bincount(at, g, wide * many)
                sums[1, a:b] += np.bincount(at, h, wide * many)
        yield from found.items()

    def splits(self, key: str, hist: np.ndarray, penalty: float, least: float) -> list[tuple]:
        wide = self.wide[key]
        hist = hist / self.units[key]
        first = wide * self.ends[:-1] + np.arange(wide)[:, None] * self.bins[self.columns]
        many = wide * self.bins[self.columns[0]]
        sums = hist[:, :many].reshape(2, wide, -1).sum(axis=2)
        return _best(hist, np.tile(self.columns, (wide, 1)), first, self.bins, sums, penalty, least)


class Advance:
    """Blocks with the word of some more trees taken in."""

    def __init__(self, wide: int, depth: int, starts: dict[str, float], trees: dict[str, list[tuple[Grown, np.ndarray]]]):
        self.wide, self.depth, self.starts = wide, depth, starts
        self.trees = {k: [(Walk(t), v) for t, v in each] for k, each in trees.items()}

    def __call__(self, block: Block) -> Block:
        x = block.bins(self.wide)
        now = np.full(x.shape[1], self.starts[block.key]) if block.now is None else block.now
        for walk, values in self.trees.get(block.key, ()):
            now = now + values[walk.nodes(x, self.depth)]
        return Block(block.key, block.number, block.x, block.y, block.w, now)


def _facts(block: Block) -> tuple:
    y, w = _plain(block.y), _plain(block.w)
    whole = bool((y == np.floor(y)).all() and (w == np.floor(w)).all() and (y >= 0).all())
    return block.key, (whole, math.fsum(w), math.fsum(w * y), float(y.min()), float(y.max()))


def boosted(base: RDD, plan, edges: Sequence[np.ndarray], facts: dict[str, list[tuple]], penalty: float, least: float) -> Iterator[pa.Table]:
    bins = np.array([len(e) + 2 for e in edges])
    wide = len(edges)
    starts, units = {}, {}
    for k, each in facts.items():
        _, w, wy, low, high = zip(*each)
        total = math.fsum(w)
        mean = math.fsum(wy) / total
        if plan.kind == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            starts[k], reach = math.log(mean / (1 - mean)), 1.0
        else:
            starts[k], reach = mean, max(1.0, 2 * (max(high) - min(low)))
        units[k] = 2.0 ** math.floor(51 - math.log2(total * reach))
        root = Grown(sums=[(0.0, total)])
        yield _table(k, -1, root, np.array([starts[k]]), edges)
    done: dict[str, list[tuple[Grown, np.ndarray]]] = {k: [] for k in facts}

    def held(blocks: RDD, last: int) -> RDD:
        """Blocks as the last so many trees leave them, without the lineage of those before."""
        out = blocks.map(Advance(wide, plan.depth, starts, {k: each[len(each) - last:] for k, each in done.items()})).persist(StorageLevel.MEMORY_AND_DISK)
        out.localCheckpoint()
        return out

    state, before = held(base, 0), None
    for t in range(plan.trees):
        draw = np.random.default_rng((plan.seed, t))
        size = max(1, round(wide * plan.column_share))
        columns = np.arange(wide) if size == wide else np.sort(draw.choice(wide, size, replace=False))
        trees = {k: Grown() for k in facts}
        for level in range(plan.depth):
            open_ = {k: tree for k, tree in trees.items() if tree.open}
            if not open_:
                break
            turn = BoostRound(plan, bins, columns, open_, t, level, units)
            try:
                sums = _gathered(state.mapPartitions(turn.add))
            except Exception:
                # Blocks of a lost executor are gone with it: all are made anew, once.
                state.unpersist()
                state = held(base, t)
                sums = _gathered(state.mapPartitions(turn.add))
            if before is not None:  # the round has made the blocks that follow it
                before.unpersist()
                before = None
            for k, tree in open_.items():
                tree.split(turn.splits(k, sums[k], penalty, least))
        for k, tree in trees.items():
            values = tree.values(penalty) * plan.rate
            done[k].append((tree, values))
            yield _table(k, t, tree, values, edges)
        if t + 1 < plan.trees:
            before, state = state, held(state, 1)
    state.unpersist()


def _gathered(sums: RDD) -> dict:
    """Sums by key; those of many partitions meet in tasks first."""
    if sums.getNumPartitions() > DIRECT:
        sums = sums.reduceByKey(np.add, DIRECT)
    out: dict = {}
    for k, v in sums.collect():
        out[k] = out[k] + v if k in out else v
    return out


def grow(rows: DataFrame, plan, edges: Sequence[np.ndarray], sizes: dict[str, int], penalty: float, least: float) -> Iterator[pa.Table]:
    """Nodes of all trees of the keys in ``sizes``, tree by tree."""
    base = blocks(rows, sizes, len(edges)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts: dict[str, list[tuple]] = {}
        for k, fact in base.map(_facts).collect():
            facts.setdefault(k, []).append(fact)
        if plan.kind == "forest":
            # A task's sums, of rows that are drawn once on average.
            most = max(math.fsum(f[1] for f in each) / base.getNumPartitions() for each in facts.values())
            whole = all(f[0] for each in facts.values() for f in each) and 2 * (most + 4 * BLOCK) < PAIRED
            yield from forest(base, plan, edges, sizes, whole)
        else:
            yield from boosted(base, plan, edges, facts, penalty, least)
    finally:
        base.unpersist()
