"""Misclassification costs, mode trade-offs, carbon-adjusted profit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators.features import add_planar_distance
from cargolens.session import cut, num_shuffle_partitions, sized

# Fixed value: cost of handling an order that would not have been late.
FALSE_ALARM_COST = 5.0


def fn_fp_costs(df: DataFrame, cost_fp: float = FALSE_ALARM_COST) -> DataFrame:
    """A missed late order costs the mean benefit, losses counted as 0."""
    return df.agg(
        F.avg(F.greatest(F.col("benefit"), F.lit(0.0))).alias("cost_fn"), F.lit(float(cost_fp)).alias("cost_fp"))


def total_cost(scored: DataFrame, cost_fn: float, cost_fp: float = FALSE_ALARM_COST,
               label: str = "label", predicted: str = "predicted") -> DataFrame:
    fn = F.count_if((F.col(label) == 1) & (F.col(predicted) == 0))
    fp = F.count_if((F.col(label) == 0) & (F.col(predicted) == 1))
    return scored.agg(fn.alias("fn"), fp.alias("fp"), (fn * float(cost_fn) + fp * float(cost_fp)).alias("total_cost"))


def threshold_grid(first: int = 10, last: int = 90) -> list[float]:
    return [i / 100 for i in range(first, last + 1)]


def cost_curve(scored: DataFrame, cost_fn: float, cost_fp: float = FALSE_ALARM_COST, score: str = "score",
               label: str = "label", grid: Sequence[float] | None = None) -> DataFrame:
    """Cost at every threshold of the grid, from one pass.

    A row only needs the number of grid points at or below its score: counting rows by that number
    leaves one small row per step, over which a running sum gives all error counts.
    """
    grid = list(grid or threshold_grid())
    splits = [float("-inf"), *grid, float("inf")]
    known = Bucketizer(splits=splits, inputCol=score, outputCol="_step").transform(scored.where(F.col(score).isNotNull()))
    steps = known.groupBy(F.col("_step").cast("int").alias("step")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    every = scored.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("step"))
    filled = every.join(steps, "step", "left").fillna(0)
    # One row per grid point from here on.
    w = W.partitionBy(F.lit(0)).orderBy("step")
    missed = F.coalesce(F.sum("pos").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    alarms = F.sum("neg").over(w.rowsBetween(0, W.unboundedFollowing))
    out = filled.select("step", missed.alias("fn"), alarms.alias("fp")).where("step > 0")
    return out.select(
        F.try_element_at(F.array(*[F.lit(t) for t in grid]), F.col("step")).alias("threshold"), "fn", "fp",
        (F.col("fn") * float(cost_fn) + F.col("fp") * float(cost_fp)).alias("total_cost"),
    )


def cost_threshold(scored: DataFrame, cost_fn: float, cost_fp: float = FALSE_ALARM_COST, score: str = "score",
                   label: str = "label") -> DataFrame:
    """Cheapest threshold (the first of equals) against the default 0.5."""
    curve = cost_curve(scored, cost_fn, cost_fp, score, label)
    best = curve.agg(
        F.min_by("threshold", F.struct("total_cost", "threshold")).alias("optimal_threshold"),
        F.min("total_cost").alias("optimal_cost"),
        F.max(F.when(F.col("threshold") == 0.5, F.col("total_cost"))).alias("default_cost"),
    )
    saved = F.col("default_cost") - F.col("optimal_cost")
    return best.withColumn("savings", saved).withColumn("savings_pct", X.ratio(saved, "default_cost") * 100)


def mode_tradeoff(df: DataFrame, group: str = "market") -> DataFrame:
    """Late rate, cost proxy, mean profit and orders per group and shipping mode."""
    return df.groupBy(group, "shipping_mode").agg(
        F.avg("late_risk").alias("late_rate"), F.avg("profit").alias("avg_profit"), F.count(F.lit(1)).alias("order_count"),
    ).withColumn("cost_proxy", X.lookup("shipping_mode", X.TRADEOFF_MODE_COST, 0.0))


#: Options of a block in the last comparison; rounds in which options meet others before it.
FRONT_BLOCK, FRONT_ROUNDS = 4096, 2


def _front(x: np.ndarray) -> np.ndarray:
    """Which of the distinct rows no other row beats: none is at least as low everywhere."""
    keep = np.zeros(len(x), bool)
    left = np.lexsort((*x.T, x.sum(axis=1)))
    while len(left):
        first, left = left[0], left[1:]
        keep[first] = True  # nothing with a larger sum beats it
        left = left[~(x[left] >= x[first]).all(axis=1)]
    return keep


def _fronts(aims: int):
    """The front of each group among the rows of a partition."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema
            x = np.stack([np.asarray(batch.column(f"a{i}"), dtype=float) for i in range(aims)], axis=1) if len(batch) else np.zeros((0, aims))
            groups = batch.column("g").dictionary_encode()
            place = np.asarray(groups.indices.fill_null(-1))
            for k in np.unique(place):
                name = None if k < 0 else groups.dictionary[int(k)].as_py()
                rows = x[place == k]
                rows = np.concatenate([held[name], rows]) if name in held else rows
                rows = np.unique(rows, axis=0)
                held[name] = rows[_front(rows)]
        if kind is not None:
            for name, rows in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kind.field("g").type), *[pa.array(rows[:, i]) for i in range(aims)]], schema=kind)

    return reduce


def _beaten(aims: int):
    """Rows of the first block of a pair that a row of the second beats."""

    def run(table: pa.Table) -> pa.Table:
        x = np.stack([np.asarray(table[f"a{i}"], dtype=float) for i in range(aims)], axis=1)
        judge = np.asarray(table["judge"])
        judges, out = x[judge], []
        for i in np.flatnonzero(~judge):
            if ((judges <= x[i]).all(axis=1) & (judges < x[i]).any(axis=1)).any():
                out.append(i)
        return table.take(pa.array(out, pa.int64())).select(["g", *[f"a{i}" for i in range(aims)]])

    return run


def pareto_front(options: DataFrame, group: str = "market", *aims: str) -> DataFrame:
    """Mark the options no other option of the group beats in all aims, which are minimised (equal options stay).

    By default the aims are ``cost_proxy`` and ``late_rate``. Every task first reduces its rows to fronts; fronts of
    several tasks meet in further rounds, dealt by hash so that one large group is spread; what is left is
    compared block by block. An option with a missing aim beats nothing and is not on the front.
    """
    aims = list(aims) or ["cost_proxy", "late_rate"]
    spark = options.sparkSession
    names = [f"a{i}" for i in range(len(aims))]
    known = F.lit(True)
    for a in aims:
        known = known & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
    left = options.where(known).select(F.col(group).alias("g"), *[(F.col(a).cast("double") + 0.0).alias(n) for a, n in zip(aims, names)])
    kind = ", ".join([f"g {dict(options.dtypes)[group]}", *[f"{n} double" for n in names]])
    for turn in range(FRONT_ROUNDS):
        if turn:
            left = left.repartition(num_shuffle_partitions(spark), F.xxhash64(F.lit(turn), *names))
        left = cut(left.mapInArrow(_fronts(len(aims)), kind))
    left = left.distinct()
    sizes = left.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / FRONT_BLOCK).cast("int").alias("n"))
    placed = left.join(sized(sizes), F.col("g").eqNullSafe(F.col("_g"))).withColumn("block", F.pmod(F.xxhash64(*names), F.col("n")).cast("int"))
    others = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = others.select("g", *names, F.col("block").alias("i"), F.col("o").alias("j"), F.lit(False).alias("judge")).unionByName(
        others.select("g", *names, F.col("o").alias("i"), F.col("block").alias("j"), F.lit(True).alias("judge")))
    beaten = pairs.groupBy("g", "i", "j").applyInArrow(_beaten(len(aims)), kind).distinct()
    l, r = left.alias("l"), beaten.alias("r")
    front = l.join(r, _all(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["g", *names]), "left_anti")
    flagged = front.select(F.col("g").alias("_g"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(1).alias("is_pareto"))
    on = _all([F.col(group).eqNullSafe(F.col("_g")), *[F.col(a).cast("double") == F.col(f"_{n}") for a, n in zip(aims, names)]])
    return options.join(flagged, on, "left").withColumn("is_pareto", F.coalesce("is_pareto", F.lit(0))).drop("_g", *[f"_{n}" for n in names])


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def dominated(options: DataFrame, group: str = "market", *aims: str) -> DataFrame:
    return pareto_front(options, group, *aims).where("is_pareto = 0").drop("is_pareto")


def esg_score(df: DataFrame) -> DataFrame:
    """Carbon, its cost, adjusted profit and profit per kg for every order line."""
    if "planar_distance_km" not in df.columns:
        df = add_planar_distance(df)
    out = df.withColumns({
        "emission_factor": X.emission_factor("market", "order_region"),
        "mode_multiplier": X.lookup("shipping_mode", X.MODE_EMISSION_MULTIPLIER, 1.0),
    })
    out = out.withColumn("carbon_kg", F.col("planar_distance_km") * F.col("emission_factor")
                         * F.col("mode_multiplier") * F.col("quantity"))
    out = out.withColumn("esg_cost", F.col("carbon_kg") * X.CARBON_PRICE_PER_KG)
    return out.withColumns({
        "esg_adjusted_profit": F.col("profit") - F.col("esg_cost"),
        "profit_per_carbon_kg": F.col("profit") / F.greatest(F.col("carbon_kg"), F.lit(0.01)),
    })


def esg_summary(scored: DataFrame, group: str = "market") -> DataFrame:
    out = scored.groupBy(group).agg(
        F.sum("profit").alias("total_profit"), F.sum("esg_cost").alias("total_esg_cost"),
        F.sum("esg_adjusted_profit").alias("total_esg_adjusted_profit"), F.avg("carbon_kg").alias("avg_carbon"),
        F.avg("profit_per_carbon_kg").alias("avg_profit_per_carbon"), F.count("order_id").alias("order_count"),
    )
    return out.withColumn("esg_cost_pct", F.bround(X.ratio("total_esg_cost", "total_profit") * 100, 2)) \
        .orderBy(F.desc("total_esg_adjusted_profit"), group)
