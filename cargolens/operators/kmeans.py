"""K-Means for many k and many starts at once: every round is one pass over the rows for all of them.

Seeding draws candidates far from those already drawn, in a few rounds for all starts together, weighs each by the rows nearest to it, and
picks the first centres of every (k, start) from the few candidates. In a Lloyd round one matrix product per block and k gives the
distances to the centres of all its states; sums by (state, centre) are added up by Spark. A state whose centres rest
drops out. What comes to the driver is bounded by states, centres and features.

Rows are packed once into blocks of numbers, by feature, so that a round neither converts rows nor leaves the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rounds and starts of a fit.
MAX_ROUNDS, STARTS = 300, 10
#: Centres rest when the squares of their moves add up to less than this (features have deviation 1).
REST = 1e-4
SEED_ROUNDS, OVERSAMPLING = 4, 2
#: Rows of a packed block; partitions whose sums come to the driver without a shuffle, which would take longer than the round itself.
BLOCK, DIRECT = 1024, 64


@dataclass
class Centres:
    """A fitted K-Means: one centre per row."""

    centres: np.ndarray
    inertia: float
    sizes: np.ndarray

    def label(self, x: Column, mean: np.ndarray | float = 0.0, deviation: np.ndarray | float = 1.0) -> Column:
        """Number of the nearest centre to the array ``x``, scaled first; equal distances go to the smaller number, null to null."""
        centres = self.centres

        @F.arrow_udf(T.IntegerType())
        def nearest(x: pa.Array) -> pa.Array:
            known = x.drop_null()
            out = np.full(len(x), -1)
            if len(known):
                out[np.asarray(x.is_valid())] = _squares((_matrix(known) - mean) / deviation, centres).argmin(axis=1)
            return pa.array(out, pa.int32(), mask=np.asarray(x.is_null()))

        return nearest(x)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    d = x @ (-2 * centres.T)
    d += (centres * centres).sum(axis=1)
    d += (x * x).sum(axis=1)[:, None]
    return np.maximum(d, 0, out=d)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``BLOCK`` rows: the bytes of a matrix with a line per feature."""
    held, count = [], 0

    def packed(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x[s:s + BLOCK].T).tobytes() for s in range(0, len(x), BLOCK)], pa.binary()),
                                          pa.array([len(x[s:s + BLOCK]) for s in range(0, len(x), BLOCK)], pa.int32())], names=["x", "n"])

    for batch in batches:
        if len(batch):
            held.append(_matrix(batch.column("x")))
            count += len(batch)
        if count >= 16 * BLOCK:
            x = np.concatenate(held)
            whole = count - count % BLOCK
            yield from packed([x[:whole]])
            held, count = [x[whole:]], count - whole
    if count:
        yield from packed(held)


def pack(rows: DataFrame) -> DataFrame:
    """The rows' arrays ``x`` as packed blocks, dealt over all cores."""
    blocks = rows.select("x").mapInArrow(_packed, "x binary, n int")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # A few small files would leave most cores idle in every round.
    return blocks if blocks.rdd.getNumPartitions() >= 2 * cores else blocks.repartition(2 * cores)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The matrices of packed blocks, by feature."""
    for batch in batches:
        for blob, n in zip(batch.column("x"), batch.column("n").to_pylist()):
            yield np.frombuffer(blob.as_buffer(), float).reshape(-1, n)


def _widened(x: np.ndarray) -> np.ndarray:
    """``x`` by feature with a line of ones and a line of squared lengths."""
    out = np.empty((len(x) + 2, x.shape[1]))
    out[:-2] = x
    out[-2] = 1
    np.einsum("ij,ij->j", x, x, out=out[-1])
    return out


def _weights(centres: np.ndarray) -> np.ndarray:
    """With these, a product with widened rows gives squared distances less the rows' own squared lengths."""
    return np.concatenate([-2 * centres, (centres * centres).sum(axis=1)[:, None]], axis=1)


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) per row from its values: the same wherever the row lies."""
    h = np.full(len(x), (0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64), np.uint64)
    for c in np.ascontiguousarray(x.T + 0.0).view(np.uint64):
        h ^= c
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _drawn(candidates: list[np.ndarray], n: int, seed: int):
    """Per start, the ``n`` rows of a partition with the least keys: rows far from the start's candidates have lower ones."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [(np.zeros(0), None)] * len(candidates)
        weights = [_weights(c) if len(c) else None for c in candidates]
        for by_feature in _blocks(batches):
            wide, x = _widened(by_feature), np.ascontiguousarray(by_feature.T)
            for s, w in enumerate(weights):
                far = np.ones(len(x)) if w is None else np.maximum((w @ wide[:-1]).min(axis=0) + wide[-1], 0)
                key = np.where(far > 0, -np.log(_uniform(x, seed * 1009 + s)) / np.maximum(far, 1e-300), np.inf)
                keys, rows = best[s]
                # Once n different rows are held, only those with keys as low as theirs count.
                low = np.flatnonzero(key <= keys[-1]) if len(keys) == n else np.flatnonzero(np.isfinite(key))
                if not len(low):
                    continue
                keys, rows = np.concatenate([keys, key[low]]), x[low] if rows is None else np.concatenate([rows, x[low]])
                rows, at = np.unique(rows, axis=0, return_index=True)  # equal rows have equal keys
                keys = keys[at]
                first = np.argsort(keys, kind="stable")[:n]
                best[s] = keys[first], rows[first]
        for s, (keys, rows) in enumerate(best):
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(keys), pa.int32()), pa.array(keys), pa.array(list(rows), pa.list_(pa.float64()))],
                                                 names=["start", "key", "x"])

    return draw


def _weighed(candidates: list[np.ndarray]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(c), np.int64) for c in candidates]
        weights = [_weights(c) for c in candidates]
        for x in _blocks(batches):
            wide = _widened(x)
            for s, w in enumerate(weights):
                count[s] += np.bincount((w @ wide[:-1]).argmin(axis=0), minlength=len(w))
        for s, n in enumerate(count):
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()), pa.array(n)], names=["start", "place", "n"])

    return weigh


def _chosen(candidates: np.ndarray, weight: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k of the candidates, each drawn with its weight times its squared distance to those before."""
    out = [int(draw.choice(len(candidates), p=weight / weight.sum()))]
    far = _squares(candidates, candidates[out]).min(axis=1)
    while len(out) < k:
        p = weight * far
        i = int(draw.choice(len(candidates), p=p / p.sum())) if p.sum() > 0 else out[0]
        out.append(i)
        far = np.minimum(far, _squares(candidates, candidates[[i]])[:, 0])
    return candidates[out].copy()


def seeds(rows: DataFrame, ks: Sequence[int], starts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """First centres of every (k, start); ``rows`` are packed."""
    candidates: list[np.ndarray] = [np.zeros((0, 0))] * starts
    kind = "start int, key double, x array<double>"
    for turn in range(SEED_ROUNDS + 1):
        n = 1 if turn == 0 else OVERSAMPLING * max(ks)
        each = rows.mapInArrow(_drawn(candidates, n, seed * 31 + turn), kind)
        order = W.partitionBy("start").orderBy("key", "x")
        found = each.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).toArrow()
        for s in range(starts):
            new = found.filter(pc.equal(found["start"], s)).sort_by("r")
            if new.num_rows:
                new = _matrix(new["x"].combine_chunks())
                candidates[s] = np.concatenate([candidates[s], new]) if len(candidates[s]) else new
    if not len(candidates[0]):
        return {}
    weights = [np.zeros(len(c)) for c in candidates]
    for r in rows.mapInArrow(_weighed(candidates), "start int, place int, n bigint").groupBy("start", "place").agg(F.sum("n").alias("n")).collect():
        weights[r["start"]][r["place"]] = r["n"]
    return {(k, s): _chosen(candidates[s], weights[s], k, np.random.default_rng((seed, k, s))) for k in ks for s in range(starts)}


def _summed(states: dict[tuple[int, int], np.ndarray]):
    keys = sorted(states)
    ends = np.cumsum([0] + [len(states[s]) for s in keys])
    # States with equally many centres go through one product.
    alike = [[s for s in keys if s[0] == k] for k in sorted({k for k, _ in keys})]
    groups = [(len(group), len(states[group[0]]), _weights(np.concatenate([states[s] for s in group]))) for group in alike]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((many * k, w.shape[1] + 1)) for many, k, w in groups]
        cost = [np.zeros((many, k)) for many, k, _ in groups]
        for x in _blocks(batches):
            wide = _widened(x)
            n = x.shape[1]
            for i, (many, k, w) in enumerate(groups):
                gap = (w @ wide[:-1]).reshape(many, k, n)
                least = gap.min(axis=1)
                mine = gap == least[:, None]
                if np.count_nonzero(mine) != many * n:  # of equally near centres the first has the row
                    mine = mine.argmax(axis=1)[:, None] == np.arange(k)[:, None]
                sums[i] += mine.reshape(many * k, n).astype(float) @ wide.T
                cost[i][:, 0] += np.maximum(least + wide[-1], 0).sum(axis=1)
        found = np.concatenate(sums)
        d = found.shape[1] - 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(found)), pa.int32()), pa.array(found[:, d]), pa.array(np.concatenate([c.ravel() for c in cost])), pa.array(found[:, d + 1]),
             *[pa.array(found[:, j]) for j in range(d)]], names=["place", "n", "cost", "square", *[f"s{j}" for j in range(d)]])

    return add, keys, ends


def _round(rows: DataFrame, states: dict[tuple[int, int], np.ndarray]):
    """Per state: rows, cost (all with the first centre), sum of squares and sums of every centre's rows."""
    add, keys, ends = _summed(states)
    d = next(iter(states.values())).shape[1]
    names = ["n", "cost", "square", *[f"s{j}" for j in range(d)]]
    parts = rows.mapInArrow(add, ", ".join(["place int", *[f"{c} double" for c in names]]))
    if rows.rdd.getNumPartitions() > DIRECT:
        parts = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names])
    found = parts.toArrow()
    table = np.zeros((ends[-1], len(names)))
    np.add.at(table, np.asarray(found["place"]), np.stack([np.asarray(found[c]) for c in names], axis=1))
    return {s: (table[a:b, 0], table[a:b, 1], table[a:b, 2], table[a:b, 3:]) for s, a, b in zip(keys, ends[:-1], ends[1:])}


def sweep(rows: DataFrame, ks: Sequence[int], starts: int = STARTS, seed: int = 42, max_rounds: int = MAX_ROUNDS) -> tuple[dict[int, Centres], dict[int, float]]:
    """The best of ``starts`` fits for every k, and its silhouette. ``rows`` has the features as an array ``x`` without nulls.

    A centre that loses all its rows stays where it is. Without rows there are no fits.
    """
    ks = list(ks)
    rows = pack(rows).persist()
    try:
        return _swept(rows, ks, starts, seed, max_rounds)
    finally:
        rows.unpersist()


def _swept(rows: DataFrame, ks: list[int], starts: int, seed: int, max_rounds: int) -> tuple[dict[int, Centres], dict[int, float]]:
    open_ = seeds(rows, ks, starts, seed)
    done: dict[tuple[int, int], tuple] = {}
    for turn in range(max_rounds):
        if not open_:
            break
        found = _round(rows, open_)
        for state, (n, cost, square, sums) in found.items():
            now = open_[state]
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now)
            if ((moved - now) ** 2).sum() <= REST or turn == max_rounds - 1:
                done[state] = now, cost.sum(), n, square, sums
                del open_[state]
            else:
                open_[state] = moved
    best: dict[int, Centres] = {}
    facts = {}
    for k in ks:
        fits = [(done[k, s][1], s) for s in range(starts) if (k, s) in done]
        if fits:
            centres, inertia, n, square, sums = done[k, min(fits)[1]]
            best[k], facts[k] = Centres(centres, float(inertia), n), (centres, n, square, sums)
    return best, silhouettes(rows, facts)


def _silhouette_sums(facts: dict[int, tuple]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: 0.0 for k in facts}
        count = 0
        for by_feature in _blocks(batches):
            x = np.ascontiguousarray(by_feature.T)
            count += len(x)
            for k, (centres, n, square, sums) in facts.items():
                own = _squares(x, centres).argmin(axis=1)
                size = np.maximum(n, 1)
                mean = (x * x).sum(axis=1)[:, None] + square / size - 2 * x @ (sums / size[:, None]).T
                mean[:, n == 0] = np.inf
                row = np.arange(len(x))
                a = mean[row, own] * n[own] / np.maximum(n[own] - 1, 1)
                mean[row, own] = np.inf
                b = mean.min(axis=1)
                s = np.where((n[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
                total[k] += s.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64()), pa.array([count] * len(total), pa.int64())],
                                         names=["k", "total", "n"])

    return add


def silhouettes(rows: DataFrame, facts: dict[int, tuple]) -> dict[int, float]:
    """Mean silhouette by squared distances of all fits, in one pass over packed rows: a mean distance to a cluster needs its sums only."""
    if not facts:
        return {}
    found = rows.mapInArrow(_silhouette_sums(facts), "k int, total double, n bigint").groupBy("k").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
    return {r["k"]: r["s"] for r in found}
