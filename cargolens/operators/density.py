"""Density clustering on a grid of small cells.

A cell is so small that any two of its points are within ``eps``. Crowded cells are therefore
settled without comparing their points, pairs of cells are settled from their bounding boxes
where possible, and only the rest is compared point by point. Equal points are folded first.
No step lists all pairs of a crowded group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.operators.scale import attach, running_totals
from cargolens.session import cut, num_shuffle_partitions

# Two boxes with more point pairs than this are split further before points are compared.
SPLIT_ABOVE = 100_000
_KEEP_DIMS = 3
# Cells per block; two blocks are compared in memory at once.
_BLOCK = 1000


def _gap2(dims: int, far: bool) -> Column:
    """Squared smallest (or largest) distance between the boxes (alo, ahi) and (blo, bhi).

    Written out per dimension: element access is compiled, array lambdas are interpreted.
    """
    if far:
        sides = [f"greatest(abs(ahi[{i}] - blo[{i}]), abs(bhi[{i}] - alo[{i}]))" for i in range(dims)]
    else:
        sides = [f"greatest(alo[{i}] - bhi[{i}], blo[{i}] - ahi[{i}], 0D)" for i in range(dims)]
    return F.expr(" + ".join(f"({v}) * ({v})" for v in sides))


def _dist2(a: str, b: str, dims: int) -> Column:
    return F.expr(" + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(dims)))


def _near_boxes(dims: int, eps: float):
    """Compare two blocks of boxes: pairs of different cells within reach of each other."""
    e2 = eps * eps

    def compare(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                alo, ahi = (np.asarray(v, float).reshape(-1, dims) for v in (row.a_lo, row.a_hi))
                blo, bhi = (np.asarray(v, float).reshape(-1, dims) for v in (row.b_lo, row.b_hi))
                acell, bcell = np.asarray(row.a_cell), np.asarray(row.b_cell)
                # A few dimensions for all pairs, then the others for the pairs still within reach.
                p, q = None, None
                near = np.zeros((len(alo), len(blo)))
                for i in range(dims):
                    if p is None:
                        gap = np.maximum(alo[:, None, i] - bhi[None, :, i], blo[None, :, i] - ahi[:, None, i])
                    else:
                        gap = np.maximum(alo[p, i] - bhi[q, i], blo[q, i] - ahi[p, i])
                    near += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
                    if p is None and (i == 3 or i == dims - 1):
                        p, q = np.nonzero((near <= e2) & (acell[:, None] != bcell[None, :]))
                        near = near[p, q]
                    elif p is not None:
                        keep = near <= e2
                        p, q, near = p[keep], q[keep], near[keep]
                if not len(p):
                    continue
                far = np.square(np.maximum(np.abs(ahi[p] - blo[q]), np.abs(bhi[q] - alo[p]))).sum(axis=1)
                an, ap, bn, bp = (np.asarray(v) for v in (row.a_n, row.a_places, row.b_n, row.b_places))
                yield pd.DataFrame({"a": acell[p], "b": bcell[q], "an": an[p], "bn": bn[q], "ap": ap[p], "bp": bp[q], "full": far <= e2})

    return compare


def _grid(x: str, side: float) -> Column:
    return F.expr(f"transform({x}, v -> cast(floor(v / {side!r}D) as bigint))")


def _boxes(points: DataFrame, keys: Sequence[str], dims: int, *extra: Column) -> DataFrame:
    lows = [F.min(F.col("x")[i]).alias(f"_lo{i}") for i in range(dims)]
    highs = [F.max(F.col("x")[i]).alias(f"_hi{i}") for i in range(dims)]
    out = points.groupBy(*keys).agg(*extra, *lows, *highs)
    kept = [c for c in out.columns if not c.startswith(("_lo", "_hi"))]
    return out.select(*kept, F.array(*[f"_lo{i}" for i in range(dims)]).alias("lo"),
                      F.array(*[f"_hi{i}" for i in range(dims)]).alias("hi"))


class _Cells:
    """Folded points, their cells, and the pairs of cells that may hold neighbours."""

    def __init__(self, points: DataFrame, features: Sequence[str], eps: float):
        self.eps, self.dims = float(eps), len(features)
        self.side = self.eps / math.sqrt(self.dims) * (1 - 1e-9)
        x = F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])
        self.rows = points.dropna(subset=list(features)).select("id", x.alias("x"))
        folded = self.rows.groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))
        folded = cut(folded.withColumn("g", _grid("x", self.side)))
        cells = _boxes(folded, ["g"], self.dims, F.min("pid").alias("cell"), F.sum("w").alias("n"),
                       F.count(F.lit(1)).alias("places"))
        self.cells = cut(cells)
        self.points = cut(folded.join(self.cells.select("g", "cell", "n"), "g").select("pid", "w", "x", "cell", "n"))
        self.pairs = cut(self._candidates())

    def _candidates(self) -> DataFrame:
        """Pairs of different cells, both ways, whose boxes come within eps; ``full`` if they never leave it.

        Cells meet through a coarse grid of side >= eps. Dimensions whose occupied coarse cells are never
        adjacent join the key as they are; of the others the most varied few are searched in both directions.
        The cells under one key are packed into blocks of limited size, and blocks (not cells) are sent to
        the neighbouring keys: a crowded key becomes many blocks that are compared in many tasks.
        """
        step = math.ceil(math.sqrt(self.dims))
        coarse = [F.floor(F.col("g")[i] / step).cast("bigint").alias(f"k{i}") for i in range(self.dims)]
        held = self.cells.select("cell", "n", "places", "lo", "hi", *coarse)
        counts = held.agg(*[F.count_distinct(f"k{i}").alias(f"k{i}") for i in range(self.dims)]).first()
        few = [i for i in range(self.dims) if counts[f"k{i}"] <= 64]
        alone = []
        if few:
            seen = held.agg(*[F.sort_array(F.collect_set(f"k{i}")).alias(f"k{i}") for i in few]).first()
            alone = [i for i in few if all(b - a > 1 for a, b in zip(seen[f"k{i}"], seen[f"k{i}"][1:]))]
        spread = sorted((i for i in range(self.dims) if i not in alone), key=lambda i: -counts[f"k{i}"])[:_KEEP_DIMS]
        keys = [f"k{i}" for i in sorted([*alone, *spread])]
        sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
        part = F.pmod(F.xxhash64("cell"), F.ceil(F.col("_m") / _BLOCK))
        blocks = cut(attach(held, sizes, keys).groupBy(*keys, part.alias("part")).agg(
            *[F.collect_list(c).alias(c) for c in ("cell", "n", "places")],
            F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi")))
        names = ("cell", "n", "places", "lo", "hi")
        ask = blocks.select(*keys, *[F.col(c).alias(f"a_{c}") for c in names])
        for i in spread:
            ask = ask.withColumn(f"k{i}", F.explode(F.expr(f"array(k{i} - 1, k{i}, k{i} + 1)")))
        meet = ask.join(blocks.select(*keys, *[F.col(c).alias(f"b_{c}") for c in names]), keys).drop(*keys)
        # The joined rows are few bytes and much work, so they are dealt over the cores.
        meet = meet.repartition(max(meet.sparkSession.sparkContext.defaultParallelism, num_shuffle_partitions(meet.sparkSession)))
        return meet.mapInPandas(_near_boxes(self.dims, self.eps), "a bigint, b bigint, an bigint, bn bigint, ap bigint, bp bigint, full boolean")

    def close_points(self, cell_pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """Joined (left point, right point) rows within eps for the given cell pairs; meant to be aggregated at once."""
        l = left.select(F.col("cell").alias("a"), F.col("pid").alias("p"), F.col("x").alias("px"))
        keep = [c for c in right.columns if c not in ("cell", "x")]
        r = right.select(F.col("cell").alias("b"), F.col("x").alias("qx"), *keep)
        return cell_pairs.join(l, "a").join(r, "b").where(_dist2("px", "qx", self.dims) <= self.eps * self.eps)


def neighbour_counts(points: DataFrame, features: Sequence[str], eps: float) -> DataFrame:
    """Points within eps of each point, itself included."""
    c = _Cells(points, features, eps)
    out = _counts(c, c.pairs, c.points)
    return c.rows.join(c.points.select("x", F.col("pid")), "x").join(out, "pid").select("id", "neighbours")


def _counts(c: _Cells, pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbour counts of ``points``: own cell, cells wholly within reach, then single points."""
    whole = pairs.where("full").groupBy(F.col("a").alias("cell")).agg(F.sum("bn").alias("_whole"))
    others = c.points.select("cell", "x", F.col("w").alias("qw"))
    single = c.close_points(pairs.where("not full").select("a", "b"), points, others) \
        .groupBy(F.col("p").alias("pid")).agg(F.sum("qw").alias("_single"))
    zero = F.lit(0)
    return points.join(whole, "cell", "left").join(single, "pid", "left").select(
        "pid", (F.col("n") + F.coalesce("_whole", zero) + F.coalesce("_single", zero)).alias("neighbours"))


def _core_points(c: _Cells, min_samples: int) -> DataFrame:
    """Folded points with at least ``min_samples`` neighbours; crowded cells need no comparison."""
    whole = c.pairs.where("full").groupBy(F.col("a").alias("cell")).agg(F.sum("bn").alias("_whole"))
    state = c.cells.select("cell", "n").join(whole, "cell", "left").select(
        "cell", ((F.col("n") + F.coalesce("_whole", F.lit(0))) >= min_samples).alias("sure"))
    marked = cut(c.points.join(state, "cell"))
    open_points = marked.where("not sure").drop("sure")
    open_cells = state.where("not sure").select(F.col("cell").alias("a"))
    counted = _counts(c, c.pairs.join(open_cells, "a", "left_semi"), open_points)
    late = open_points.join(counted.where(F.col("neighbours") >= min_samples).select("pid"), "pid", "left_semi")
    return marked.where("sure").drop("sure").unionByName(late).select("pid", "cell", "x")


def _witnesses(c: _Cells, core: DataFrame) -> DataFrame:
    """(cell, x): one core point of each cell, from about the middle of its grid square."""
    off = " + ".join(f"pow(x[{i}] - (floor(x[{i}] / {c.side!r}D) + 0.5D) * {c.side!r}D, 2)" for i in range(c.dims))
    chosen = core.groupBy("cell").agg(F.min_by("pid", F.expr(off)).alias("pid"))
    return core.join(chosen, ["cell", "pid"]).select("cell", "x").dropDuplicates(["cell"])


def _parts(c: _Cells, core: DataFrame) -> DataFrame:
    """(node, root) of the cells with core points: the smallest cell each is connected to.

    Cells are first tied by their boxes and by one point of each. Core points are then compared only across
    cells that are not yet connected, so a dense cloud is not searched for links it does not need.
    """
    home = cut(core.select("cell").distinct())
    seen = cut(_witnesses(c, core))
    base = c.pairs.where("a < b").select("a", "b", "full").join(home.withColumnRenamed("cell", "a"), "a", "left_semi") \
        .join(home.withColumnRenamed("cell", "b"), "b", "left_semi") \
        .join(seen.select(F.col("cell").alias("a"), F.col("x").alias("px")), "a", "left") \
        .join(seen.select(F.col("cell").alias("b"), F.col("x").alias("qx")), "b", "left")
    near = F.coalesce(_dist2("px", "qx", c.dims) <= c.eps * c.eps, F.lit(False))
    base = cut(base.select("a", "b", (F.col("full") | near).alias("tied")))
    parts = cut(connected_components(home.select(F.col("cell").alias("node")), base.where("tied").select("a", "b")))
    root = {name: parts.select(F.col("node").alias(name), F.col("root").alias(f"r{name}")) for name in "ab"}
    apart = base.where("not tied").join(root["a"], "a").join(root["b"], "b").where("ra != rb")
    apart = cut(apart.select("a", "b", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")))
    if apart.isEmpty():
        return parts
    links = _touching(c, core, apart)
    if links.isEmpty():
        return parts
    tops = connected_components(parts.select(F.col("root").alias("node")).distinct(), links)
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return parts.join(tops, "root").select("node", F.col("top").alias("root"))


def _touching(c: _Cells, core: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs of parts (a < b) with two core points within eps, found over the pairs of cells in ``apart`` (a, b, parts ra, rb).

    Boxes around the core points settle most pairs. Pairs of large boxes are split into half-size
    boxes, round by round, until boxes settle them or few enough points remain to compare. Once two
    parts are linked, their other pairs are dropped.
    """
    some = apart.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    core = cut(core.join(some, "cell", "left_semi"))
    names = ["a", "b", "ra", "rb"]
    found = apart.select("ra", "rb").limit(0)
    none = F.lit(None).cast("array<bigint>")
    work = apart.select(*names, none.alias("ka"), none.alias("kb"))
    small = None
    for level in range(60):
        here, above = _grid("x", c.side / 2 ** level), _grid("x", c.side / 2 ** (level - 1)) if level else none
        boxes = _boxes(core.select("cell", "x", here.alias("k"), above.alias("up")), ["cell", "k", "up"], c.dims,
                       F.count(F.lit(1)).alias("n"))
        if level == 0:
            boxes = boxes.withColumn("up", none)
        sides = []
        for name in ("a", "b"):
            sides.append(boxes.select(F.col("cell").alias(name), F.col("up").alias(f"k{name}"), F.col("k").alias(f"{name}k"),
                                      F.col("n").alias(f"{name}n"), F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi")))
        joined = work
        for name, side in zip("ab", sides):
            same = F.col(f"w.{name}") == F.col(f"s.{name}")
            same = same & F.col(f"w.k{name}").eqNullSafe(F.col(f"s.k{name}"))
            joined = joined.alias("w").join(side.alias("s"), same).select(
                "w.*", *[F.col(f"s.{name}{t}") for t in ("k", "n", "lo", "hi")])
        e2 = c.eps * c.eps
        tested = joined.withColumn("near2", _gap2(c.dims, far=False)) \
            .withColumn("far2", _gap2(c.dims, far=True)).where(F.col("near2") <= e2)
        tested = cut(tested.select(*names, "ak", "bk", "an", "bn", (F.col("far2") <= e2).alias("hit")))
        found = cut(found.unionByName(tested.where("hit").select("ra", "rb")).distinct())
        left = tested.where("not hit").join(found, ["ra", "rb"], "left_anti")
        few = F.col("an") * F.col("bn") <= SPLIT_ABOVE
        part = left.where(few).select(*names, "ak", "bk", F.lit(level).alias("level"))
        small = part if small is None else small.unionByName(part)
        work = cut(left.where(~few).select(*names, F.col("ak").alias("ka"), F.col("bk").alias("kb")))
        if work.isEmpty():
            break
    levels = [r[0] for r in small.select("level").distinct().collect()]  # one number per round
    for level in sorted(levels):
        keyed = core.select("cell", "pid", "x", _grid("x", c.side / 2 ** level).alias("k"))
        l = keyed.select(F.col("cell").alias("a"), F.col("k").alias("ak"), F.col("x").alias("px"))
        r = keyed.select(F.col("cell").alias("b"), F.col("k").alias("bk"), F.col("x").alias("qx"))
        todo = small.where(F.col("level") == level).join(found, ["ra", "rb"], "left_anti")
        hit = todo.join(l, ["a", "ak"]).join(r, ["b", "bk"]).where(_dist2("px", "qx", c.dims) <= c.eps * c.eps)
        found = cut(found.unionByName(hit.select("ra", "rb")).distinct())
    return found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node is connected to.

    Alternates two steps that hang every neighbour of a node on the smallest one seen, first for larger
    then for smaller neighbours; the number of rounds grows with the logarithm of the graph, not with
    the length of its chains. Every round is written out, so no lineage piles up.
    """
    def held(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    old_sum = held(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = cut(step.where("u != v").distinct())
        # Finished when the edges no longer change: then every node hangs on its root.
        new_sum = held(new)
        e = new
        if old_sum == new_sum:
            break
        old_sum = new_sum
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def dbscan(points: DataFrame, features: Sequence[str], eps: float, min_samples: int = 10) -> DataFrame:
    """(id, label) for every complete row; noise is -1.

    Labels count up in the order of the smallest core id of a cluster. A border point goes to the
    smallest label in reach.
    """
    c = _Cells(points, features, eps)
    core = cut(_core_points(c, min_samples))
    home = core.groupBy("cell").agg(F.min("pid").alias("first"))
    grouped = cut(home.join(_parts(c, core), F.col("cell") == F.col("node")).select("cell", "first", "root"))
    clusters = grouped.groupBy("root").agg(F.min("first").alias("first")).withColumn("one", F.lit(1))
    numbered = running_totals(clusters, "first", {"k": "one"})
    labels = cut(grouped.join(numbered.select("root", F.col("k_before").alias("label")), "root").select("cell", "label"))
    core_labels = core.join(labels, "cell").select("pid", "cell", "x", "label")
    open_points = c.points.join(core.select("pid"), "pid", "left_anti")
    inside = open_points.join(labels, "cell").select("pid", "label")
    reach = c.pairs.join(labels.select(F.col("cell").alias("b"), F.col("label").alias("bl")), "b") \
        .join(open_points.select(F.col("cell").alias("a")).distinct(), "a", "left_semi")
    single = c.close_points(reach.select("a", "b"), open_points, core_labels.select("cell", "x", "label")).select(
        F.col("p").alias("pid"), "label")
    border = inside.unionByName(single).groupBy("pid").agg(F.min("label").alias("label"))
    settled = core_labels.select("pid", "label").unionByName(border)
    folded = c.points.select("pid", "x").join(settled, "pid", "left")
    return c.rows.join(folded.select("x", "label"), "x").select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
