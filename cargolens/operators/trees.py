"""Tree ensembles for many keys at once: boosted trees and forests of regions, folds or curve points in one job.

Features are cut into at most ``BINS`` bins by quantiles and every row travels as a string of bytes. Rows are
dealt by key (and, in forests, by block of trees), each group grows its trees level by level from histograms, and the nodes
come back as a table: that table is the model. So one Spark job fits all keys, whatever the number of trees.
A group is one task's work, therefore bounded: the trees of a key with more than ``TASK_ROWS`` rows are grown by all tasks together
(``levels``). All rows teach, unless the caller bounds them. Scoring has no bound: it is one pass over any number of rows.

A missing value lies below all others. Results do not depend on how rows are dealt to partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.operators import levels
from cargolens.session import cut, num_shuffle_partitions, sized

#: Bins of a feature, the missing values' one included; rows of a key whose trees one task grows.
BINS, TASK_ROWS = 128, 1 << 18
#: Penalty of a leaf's size and least curvature of a leaf, in boosting.
PENALTY, LEAST_CURVE = 1.0, 1.0
#: Trees of a forest grown by one task.
TREE_BLOCK = 25
#: Whole numbers below this are held in pairs by one double.
PAIRED = float(1 << 26)
#: Partitions of the groups, in shuffle partitions.
SPREAD = 4
NODES = "key string, tree int, node int, feature int, threshold double, child int, value double, gain double, cover double"


@dataclass(frozen=True)
class Plan:
    """How the trees of a group are grown."""

    kind: str  # 'squared', 'logistic' (boosted) or 'forest'
    trees: int
    depth: int
    rate: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


# --- Bins --------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of every feature, from one quantile sketch. A value with a larger share than 1 / (bins - 1) ends a bin."""
    shares = [(i + 1) / (bins - 1) for i in range(bins - 2)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100 * bins).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array([x for x in found[f"e{i}"] or [] if not np.isnan(x)], float)) for i in range(len(features))]


#: Values of a feature that a task holds with their counts; and that it hands on. Beyond them, neighbours are merged into the largest.
HELD, HANDED = 1 << 16, 1 << 14


def _merged(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order with their counts; those beyond ``most`` go to a next larger one, in even shares."""
    order = np.argsort(values, kind="stable")
    values, total = values[order], counts[order].cumsum()
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, np.int64)
    values, total = values[last], total[last]
    if len(values) > most:
        keep = np.unique(np.searchsorted(total, np.arange(1, most + 1) * (total[-1] / most), "left").clip(max=len(total) - 1))
        values, total = values[keep], total[keep]
    return values, np.diff(total, prepend=0)


def _value_counts(names: Sequence[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        new: list[list[np.ndarray]] = [[] for _ in names]
        fresh = 0

        def settle() -> None:
            for i, parts in enumerate(new):
                v, n = held[i]
                more, often = np.unique(np.concatenate(parts), return_counts=True)
                v, n = _merged(np.concatenate([v, more]), np.concatenate([n, often]), HELD)
                held[i] = (v, n) if len(v) < HELD else _merged(v, n, HELD // 2)
                new[i] = []

        for batch in batches:
            for i, c in enumerate(names):
                new[i].append(np.asarray(batch.column(c).drop_null(), dtype=float) + 0.0)
            fresh += len(batch)
            if fresh >= 2 * HELD:
                settle()
                fresh = 0
        if fresh:
            settle()
        for i, (v, n) in enumerate(held):
            v, n = _merged(v, n, HANDED)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(v), pa.int32()), pa.array(v), pa.array(n, pa.int64())], names=["i", "v", "n"])

    return count


def _ends(bins: int):
    def ends(table: pa.Table) -> pa.Table:
        v, n = _merged(np.asarray(table["v"]), np.asarray(table["n"]), len(table))
        total = n.cumsum()
        at = np.searchsorted(total, np.arange(1, bins - 1) * (total[-1] / (bins - 1)) * (1 - 1e-12), "left")
        found = np.unique(v[at])
        return pa.table({"i": pa.array([table["i"][0].as_py()] * len(found), pa.int32()), "v": pa.array(found)})

    return ends


def counted_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """``bin_edges`` from counted values instead of a sketch, which is slow on many rows."""
    each = rows.select(*[F.col(c).cast("double").alias(c) for c in features])
    counted = each.mapInArrow(_value_counts(list(features)), "i int, v double, n bigint")
    found = counted.groupBy("i").applyInArrow(_ends(bins), "i int, v double").toArrow()
    i, v = np.asarray(found["i"]), np.asarray(found["v"])
    return [np.sort(v[(i == k) & ~np.isnan(v)]) for k in range(len(features))]


def number(column: pa.Array) -> np.ndarray:
    """Doubles with missing values below all others."""
    x = np.asarray(column.cast(pa.float64()).fill_null(float("nan")), dtype=float)
    return np.where(np.isnan(x), -np.inf, x)


def _binned(edges: list[np.ndarray], passed: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((len(batch), len(edges)), np.uint8)
            for i, e in enumerate(edges):
                v = number(batch.column(f"f{i}"))
                x[:, i] = np.where(v == -np.inf, 0, 1 + np.searchsorted(e, v, "left"))
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(edges)), len(batch), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], blobs.cast(pa.binary())], names=[*passed, "x"])

    return run


# --- Growing -----------------------------------------------------------------------------


def _whole(g: np.ndarray, h: np.ndarray) -> bool:
    """Whether sums of both are whole numbers small enough to share one double."""
    return bool((g == np.floor(g)).all() and (h == np.floor(h)).all() and (g >= 0).all() and (h >= 0).all() and max(g.sum(), h.sum()) < PAIRED)


def _histograms(at: np.ndarray, g: np.ndarray, h: np.ndarray, size: int, paired: bool, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``g`` and ``h`` by ``at``; whole numbers share one pass, and a weight of one is counted."""
    if paired:
        both = np.bincount(at, h * PAIRED + g, size)
        high = np.floor(both / PAIRED)
        return both - high * PAIRED, high
    return np.bincount(at, g, size), np.bincount(at, minlength=size).astype(float) if counted else np.bincount(at, h, size)


def _bounds(plan: Plan) -> tuple[float, float]:
    """Penalty of a leaf's size and least curvature of a leaf."""
    return (0.0, 1e-12) if plan.kind == "forest" else (PENALTY, LEAST_CURVE)


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, plan: Plan, edges: list[np.ndarray], draw: np.random.Generator):
    """One tree on ``rows``: (feature, threshold, child, value, gain, cover) of its nodes, breadth first, and each row's leaf.

    ``x`` is by feature. ``g`` over ``h`` is the value that a leaf takes on; in boosting with a penalty.
    """
    forest = plan.kind == "forest"
    penalty, least = _bounds(plan)
    n_features = len(x)
    size = max(1, round(n_features ** 0.5)) if forest else max(1, round(n_features * plan.column_share))
    columns = np.arange(n_features) if forest else np.sort(draw.choice(n_features, size, replace=False))
    nodes: list[list] = []
    level = [0]
    leaf = np.zeros(len(g), np.int32)
    # Sums of the rows in play, next to each other; whole numbers go through a histogram in pairs.
    mine_g, mine_h = g[rows], h[rows]
    nodes.append([-1, np.inf, 0, 0.0, 0.0, mine_h.sum()])
    nodes[0][3] = mine_g.sum() / max(nodes[0][5] + penalty, 1e-12)
    paired, counted = _whole(mine_g, mine_h), bool((mine_h == 1).all())
    place = np.zeros(len(rows), np.int64)  # of each row's node in the level
    mine_x = x if forest or len(rows) == len(g) else x[:, rows]
    room = np.empty(len(rows), np.int64)
    for _ in range(plan.depth):
        wide = len(level)
        bases: dict[int, np.ndarray] = {}
        if not wide or not len(rows):
            break
        best = np.full(wide, 1e-9)
        split = np.full((wide, 2), -1, np.int64)
        left = np.zeros((wide, 2))
        sums = np.stack([np.bincount(place, mine_g, wide), np.bincount(place, mine_h, wide)])
        base = sums[0] ** 2 / np.maximum(sums[1] + penalty, 1e-12)
        # A forest's node looks at its own draw of features; a boosted tree's nodes share one.
        open_ = np.ones((n_features, wide), bool)
        if forest:
            open_ = np.argsort(np.argsort(draw.random((n_features, wide)), axis=0), axis=0) < size
            # Rows of a node side by side, so that a feature meets only the nodes that drew it.
            order = np.argsort(place.astype(np.uint8 if wide <= 256 else np.uint16 if wide <= 65536 else np.int64), kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=wide))])
        for f in columns:
            here = np.flatnonzero(open_[f])
            if not len(here):
                continue
            bins = len(edges[f]) + 2
            if len(here) == wide:
                if bins not in bases:
                    bases[bins] = place * bins
                at, sum_g, sum_h = np.add(bases[bins], x[f].take(rows) if forest else mine_x[f], out=room[:len(rows)]), mine_g, mine_h
            else:
                these = np.concatenate([order[ends[i]:ends[i + 1]] for i in here])
                at = np.repeat(np.arange(len(here)) * bins, ends[here + 1] - ends[here]) + x[f].take(rows.take(these))
                sum_g, sum_h = mine_g.take(these), mine_h.take(these)
            hist_g, hist_h = _histograms(at, sum_g, sum_h, len(here) * bins, paired, counted)
            hist_g, hist_h = (v.reshape(-1, bins)[:, :-1].cumsum(axis=1) for v in (hist_g, hist_h))
            right_g, right_h = sums[0][here, None] - hist_g, sums[1][here, None] - hist_h
            fits = (hist_h >= least) & (right_h >= least)
            gain = np.where(fits, hist_g ** 2 / np.maximum(hist_h + penalty, 1e-12) + right_g ** 2 / np.maximum(right_h + penalty, 1e-12), -np.inf)
            gain -= base[here, None]
            b = np.argmax(gain, axis=1)
            line = np.arange(len(here))
            top = gain[line, b]
            better = top > best[here] + 1e-9 * np.abs(best[here])
            line, b, found = line[better], b[better], here[better]
            best[found] = top[better]
            split[found, 0], split[found, 1] = f, b
            left[found, 0], left[found, 1] = hist_g[line, b], hist_h[line, b]
        goes = split[:, 0] >= 0
        if not goes.any():
            break
        next_level = []
        first = np.zeros(wide, np.int64)
        for i in np.flatnonzero(goes):
            f, b = split[i]
            node = nodes[level[i]]
            node[0], node[1], node[2], node[4] = int(f), float(edges[f][b - 1]) if b > 0 else -np.inf, len(nodes), float(best[i])
            first[i] = len(next_level)
            for a, c in (left[i], sums[:, i] - left[i]):
                next_level.append(len(nodes))
                nodes.append([-1, np.inf, 0, a / max(c + penalty, 1e-12), 0.0, c])
        if not goes.all():
            stays = ~goes[place]
            leaf[rows[stays]] = np.array(level)[place[stays]]
            rows, place, mine_g, mine_h = (v[~stays] for v in (rows, place, mine_g, mine_h))
            mine_x = mine_x if forest else mine_x[:, ~stays]
        values = x.ravel().take((split[:, 0] * x.shape[1]).take(place) + rows)
        place = first.take(place) + (values > split[:, 1].take(place))
        level = next_level
    if len(rows):
        leaf[rows] = np.array(level)[place]
    out = [np.array(c) for c in zip(*nodes)]
    ends = out[0] < 0
    out[2] = np.where(ends, np.arange(len(ends)), out[2])  # a leaf leads to itself
    return out, leaf


def _walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of every row; ``x`` is by row. A leaf leads to itself."""
    at = np.zeros(len(x), np.int64)
    row = np.arange(len(x))
    for _ in range(depth):
        at = child[at] + (x[row, np.maximum(feature[at], 0)] > threshold[at])
    return at


def _ensemble(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: Plan, edges: list[np.ndarray], first: int, last: int):
    """(tree, nodes) of trees ``first`` to ``last``; boosted ensembles begin with a constant as tree -1."""
    n = len(y)
    every = np.arange(n)
    if plan.kind == "forest":
        for t in range(first, last):
            draw = np.random.default_rng((plan.seed, t))
            often = draw.poisson(1.0, n) * w
            rows = every[often > 0]
            yield t, _grown(x, often * y, often, rows, plan, edges, draw)[0]
        return
    mean = (w * y).sum() / w.sum()
    if plan.kind == "logistic":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        start = np.log(mean / (1 - mean))
    else:
        start = mean
    yield -1, [np.array(c) for c in ([-1], [np.inf], [0], [start], [0.0], [w.sum()])]
    now = np.full(n, start)
    for t in range(plan.trees):
        draw = np.random.default_rng((plan.seed, t))
        if plan.kind == "logistic":
            p = 1 / (1 + np.exp(-now))
            g, h = w * (y - p), w * p * (1 - p)
        else:
            g, h = w * (y - now), w
        rows = every[draw.random(n) < plan.row_share] if plan.row_share < 1 else every
        nodes, leaf = _grown(x, g, h, rows, plan, edges, draw)
        nodes[3] = nodes[3] * plan.rate
        if len(rows) < n:  # the rows left out take their leaf by walking
            rest = np.ones(n, bool)
            rest[rows] = False
            bins = np.array([0 if f < 0 or v == -np.inf else 1 + np.searchsorted(edges[f], v, "left") for f, v in zip(nodes[0], nodes[1])])
            bins = np.where(nodes[0] < 0, BINS, bins)
            leaf[rest] = _walk(x.T[rest], nodes[0], bins, nodes[2], plan.depth)
        now += nodes[3][leaf]
        yield t, nodes


def _group(plan: Plan, edges: list[np.ndarray]):
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        key, block = table["key"][0].as_py(), table["block"][0].as_py()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.uint8).reshape(-1, len(edges)).T.copy()
        y, w = np.asarray(table["y"], dtype=float), np.asarray(table["w"], dtype=float)
        first, last = (block * TREE_BLOCK, min(plan.trees, (block + 1) * TREE_BLOCK)) if plan.kind == "forest" else (0, plan.trees)
        parts = []
        for t, (feature, threshold, child, value, gain, cover) in _ensemble(x, y, w, plan, edges, first, last):
            n = len(feature)
            parts.append(pa.table({
                "key": pa.array([key] * n, pa.string()), "tree": pa.array([t] * n, pa.int32()), "node": pa.array(np.arange(n), pa.int32()),
                "feature": pa.array(feature.astype(np.int32)), "threshold": pa.array(threshold.astype(float)), "child": pa.array(child.astype(np.int32)),
                "value": pa.array(value.astype(float)), "gain": pa.array(gain.astype(float)), "cover": pa.array(cover.astype(float))}))
        return pa.concat_tables(parts)

    return grow


def fit(rows: DataFrame, features: Sequence[str], plan: Plan, target: str, key: Column | None = None, weight: Column | None = None,
        train_rows: int | None = None) -> Ensemble:
    """One ensemble per value of ``key`` (or a single one), from all rows; those of keys within ``TASK_ROWS`` in one job.

    Rows without a target or a key teach nothing. Where a caller gives ``train_rows``, a key with more rows is represented by
    about that many, chosen by a hash of features and target.
    """
    features = list(features)
    one = F.lit("") if key is None else key.cast("string")
    base = rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"),
                       (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), one.alias("key")).where("y IS NOT NULL AND key IS NOT NULL AND w > 0")
    names = [f"f{i}" for i in range(len(features))]
    base = base.withColumn("order", F.xxhash64("key", "y", *names))
    if train_rows is not None:
        # Chosen before they are binned, so that only the rows that teach pass through Python.
        sizes = base.groupBy("key").agg((F.lit(float(train_rows)) / F.count(F.lit(1))).alias("share"))
        # A second hash keeps the choice apart from the order in which a group's rows are taken.
        # The few shares are materialised: only then is the join planned as a broadcast, and no row is shuffled for it.
        base = base.join(sized(sizes), "key").where(F.pmod(F.xxhash64("order", F.lit(1)), F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    large = {r["key"]: r["n"] for r in base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS).collect()}
    edges = (counted_edges if large else bin_edges)(base, names)
    binned = lambda some: some.mapInArrow(_binned(edges, ["key", "y", "w", "order"]), "key string, y double, w double, order long, x binary")
    chosen = binned(base.where(~F.col("key").isin(list(large))) if large else base)
    blocks = -(-plan.trees // TREE_BLOCK) if plan.kind == "forest" else 1
    dealt = chosen.select("key", "y", "w", "order", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Groups are few and their bytes small, but each is minutes of work: their number of partitions is not left to their size.
    spread = dealt.repartition(SPREAD * num_shuffle_partitions(rows.sparkSession), "key", "block")
    nodes = spread.groupBy("key", "block").applyInArrow(_group(plan, edges), NODES)
    if large:
        penalty, least = _bounds(plan)
        shared = rows.sparkSession.createDataFrame(pa.concat_tables(levels.grow(
            binned(base.where(F.col("key").isin(list(large)))), plan, edges, large, penalty, least)), NODES)
        nodes = shared if key is None else nodes.unionByName(shared)
    nodes = cut(nodes)
    return Ensemble(nodes, features, plan.kind, plan.depth)


# --- Scoring -----------------------------------------------------------------------------


def _arrays(nodes: pa.Table) -> dict[str, list[tuple]]:
    """Trees by key, in order."""
    out: dict[str, list[tuple]] = {}
    nodes = nodes.sort_by([("key", "ascending"), ("tree", "ascending"), ("node", "ascending")])
    feature, threshold, child, value = (np.asarray(nodes[c]) for c in ("feature", "threshold", "child", "value"))
    starts = np.flatnonzero(np.asarray(nodes["node"]) == 0)
    keys = nodes["key"].to_pylist()
    for a, b in zip(starts, [*starts[1:], len(nodes)]):
        out.setdefault(keys[a], []).append((feature[a:b], threshold[a:b], child[a:b], value[a:b]))
    return out


def tree_sum(x: np.ndarray, trees: list[tuple], depth: int) -> np.ndarray:
    out = np.zeros(len(x))
    for feature, threshold, child, value in trees:
        out += value[_walk(x, feature, threshold, child, depth)] if len(value) > 1 else value[0]
    return out


#: Trees with at most this many leaves are read by masks of leaves; rows and trees that are scored together stay in the processor's cache.
MASKED, ROWS_AT_ONCE, TREES_AT_ONCE = 64, 512, 128


def _leaf_masks(trees: list[tuple], cuts: list[np.ndarray], kind: type) -> tuple[list[np.ndarray], np.ndarray]:
    """Per feature, by bin and tree, the leaves still open; and the leaves' values by tree, from left to right.

    A node whose condition sends a row to the right closes all leaves on its left, so the first leaf open for all features is the row's.
    """
    masks = [np.full((len(c) + 1, len(trees)), ~kind(0), kind) for c in cuts]
    values = np.zeros((len(trees), MASKED))
    for t, (feature, threshold, child, value) in enumerate(trees):
        count = 0

        def down(node: int) -> None:
            nonlocal count
            f = feature[node]
            if f < 0:
                values[t, count] = value[node]
                count += 1
                return
            first = count
            down(child[node])
            closed = kind((1 << count) - (1 << first))
            masks[f][np.searchsorted(cuts[f], threshold[node]) + 1:, t] &= ~closed
            down(child[node] + 1)

        down(0)
    return masks, values


class Forest:
    """Trees of one model, laid out for sums over many rows: the same sums as ``tree_sum``, in the same order.

    A row's bin in a feature is the number of the trees' thresholds below its value, so bins meet conditions as values do.
    """

    def __init__(self, trees: list[tuple], depth: int):
        self.trees, self.depth = trees, depth
        leaves = max([int((np.asarray(t[0]) < 0).sum()) for t in trees], default=0)
        self.masked = 0 < leaves <= MASKED
        if self.masked:
            feature, threshold = (np.concatenate([np.asarray(t[i]) for t in trees]) for i in (0, 1))
            self.cuts = [np.unique(threshold[feature == f]) for f in range(max(int(feature.max()), 0) + 1)]
            kind = np.uint32 if leaves <= 32 else np.uint64
            self.blocks = [_leaf_masks(trees[s:s + TREES_AT_ONCE], self.cuts, kind) for s in range(0, len(trees), TREES_AT_ONCE)]

    def total(self, x: np.ndarray) -> np.ndarray:
        if not self.masked:
            return tree_sum(x, self.trees, self.depth)
        return np.concatenate([np.zeros(0), *[self._by_masks(x[s:s + ROWS_AT_ONCE]) for s in range(0, len(x), ROWS_AT_ONCE)]])

    def _by_masks(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        bins = [(f, np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(self.cuts) if len(c)]
        for masks, values in self.blocks:
            open_ = np.full((len(x), len(values)), ~masks[0].dtype.type(0))
            for f, b in bins:
                open_ &= masks[f].take(b, axis=0)
            # The lowest open leaf: the exponent of its bit as a double.
            low = (open_ & (~open_ + open_.dtype.type(1))).astype(float).view(np.int64)
            leaf = (low >> 52) + (np.arange(len(values)) * MASKED - 1023)
            found = np.empty((len(values) + 1, len(x)))
            found[0], found[1:] = out, values.ravel()[leaf].T
            out = np.add.reduce(found, axis=0)  # line by line, in the order of the trees
        return out


def _link(total: np.ndarray, trees: int, kind: str) -> np.ndarray:
    if kind == "forest":
        return total / max(trees, 1)
    return 1 / (1 + np.exp(-total)) if kind == "logistic" else total


class Ensemble:
    """Fitted trees of all keys: ``nodes`` is the table of them, its size set by keys, trees and depth."""

    def __init__(self, nodes: DataFrame, features: Sequence[str], kind: str, depth: int):
        self.nodes, self.features, self.kind, self.depth = nodes, list(features), kind, depth
        self._udf = None

    @property
    def keys(self) -> list[str]:
        return [r[0] for r in self.nodes.select("key").distinct().orderBy("key").collect()]

    def arrays(self) -> dict[str, list[tuple]]:
        """(feature, threshold, child, value) of every tree by key: what tasks hold."""
        return _arrays(self.nodes.toArrow())

    def _scorer(self):
        if self._udf is None:
            spark: SparkSession = self.nodes.sparkSession
            sent = spark.sparkContext.broadcast(self.arrays())
            kind, depth = self.kind, self.depth
            laid: dict[str, Forest] = {}

            @F.arrow_udf(T.DoubleType())
            def score(key: pa.Array, x: pa.Array) -> pa.Array:
                models = sent.value
                wide = max(1, len(x.flatten()) // max(1, len(x)))
                values = number(x.flatten()).reshape(-1, wide)
                out = np.full(len(x), np.nan)
                names = key.dictionary_encode()
                place = np.asarray(names.indices.fill_null(-1))
                for i, name in enumerate(names.dictionary.to_pylist()):
                    if name in models:
                        mine = place == i
                        if name not in laid:
                            laid[name] = Forest(models[name], depth)
                        out[mine] = _link(laid[name].total(values[mine]), len(models[name]), kind)
                return pa.array(out, from_pandas=True)

            self._udf = score
        return self._udf

    def score(self, x: Column | None = None, key: Column | None = None) -> Column:
        """The prediction (boosted regression) or the probability of 1, null for a key without a model.

        ``x`` is an array of the features' values in order; by default it is made of the columns of their names.
        """
        x = F.array(*[F.col(c).cast("double") for c in self.features] or [F.lit(0.0)]) if x is None else x
        return self._scorer()(F.lit("") if key is None else key.cast("string"), x)

    def importance(self) -> DataFrame:
        """(feature, importance): each feature's share of all gains; over several keys of the sum of them."""
        names = self.nodes.sparkSession.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        # Every tree of a forest has the same say, as its gains are made a share of its own.
        gains = self.nodes.where("feature >= 0").groupBy("key", "tree", "feature").agg(F.sum("gain").alias("g"))
        if self.kind == "forest":
            whole = gains.groupBy("key", "tree").agg(F.sum("g").alias("t"))
            gains = gains.join(whole, ["key", "tree"]).select("feature", (F.col("g") / F.col("t")).alias("g"))
        by = gains.groupBy("feature").agg(F.sum("g").alias("g"))
        total = by.agg(F.sum("g")).scalar()
        return names.join(by, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("g") / total, F.lit(0.0)).alias("importance")) \
            .orderBy(F.desc("importance"), "feature")


def constant(spark: SparkSession, values: dict[str, float], features: Sequence[str] = ()) -> Ensemble:
    """A model that gives each key its value; ``""`` is the key of models without keys."""
    rows = [(k, -1, 0, -1, float("inf"), 0, float(v), 0.0, 1.0) for k, v in values.items()]
    return Ensemble(spark.createDataFrame(rows, NODES), features, "squared", 0)
