"""Regional reports: rates, totals, cross tables, correlations, insights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators.scale import dominant, exact_quantiles

REGION = "macro_region"


def late_rate_by_region(df: DataFrame) -> DataFrame:
    """Late rate per region, highest first, next to the rate over all rows."""
    regions = df.groupBy(REGION).agg(F.sum("late_risk").alias("late"), F.count("late_risk").alias("n"))
    everything = W.partitionBy(F.lit(0))  # over one row per region, not over the orders
    return regions.select(
        REGION, X.ratio("late", "n").alias("late_rate"),
        (F.sum("late").over(everything) / F.sum("n").over(everything)).alias("global_rate"),
    ).orderBy(F.desc("late_rate"), REGION)


def sales_by_region(df: DataFrame) -> DataFrame:
    return df.groupBy(REGION).agg(
        F.sum("sales").alias("total_sales"), F.avg("sales").alias("avg_sales"), F.count("sales").alias("orders")
    ).orderBy(F.desc("total_sales"), REGION)


def top_regions(df: DataFrame, k: int) -> DataFrame:
    """The k regions with the most rows; names decide ties."""
    return df.groupBy(REGION).count().orderBy(F.desc("count"), REGION).limit(k)


def _in_top(df: DataFrame, k: int) -> DataFrame:
    # The right side has k rows at most, so its broadcast is bounded.
    return df.join(F.broadcast(top_regions(df, k).select(REGION)), REGION, "left_semi")


def shipping_days_box(df: DataFrame, k: int = 15) -> DataFrame:
    """Box-plot numbers of shipping days: quartiles, whiskers at 1.5 box lengths, outlier count."""
    top = _in_top(df, k)
    box = exact_quantiles(top, ["days_real"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, [REGION]).drop("column")
    counts = top.where(F.col("days_real").isNotNull()).groupBy(REGION, "days_real").count()
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("days_real").between(F.col("q1") - reach, F.col("q3") + reach)
    return counts.join(box, REGION).groupBy(REGION).agg(
        F.min("days_real").alias("low"), F.min(F.when(inside, F.col("days_real"))).alias("whisker_low"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.max(F.when(inside, F.col("days_real"))).alias("whisker_high"), F.max("days_real").alias("high"),
        F.sum(F.when(~inside, F.col("count")).otherwise(0)).alias("outliers"),
    )


def seasonal_demand(df: DataFrame, k: int = 6) -> DataFrame:
    return _in_top(df, k).groupBy(REGION, "order_month").agg(F.sum("sales").alias("total_sales"))


CORRELATION_FEATURES = [
    "days_real", "days_scheduled", "sales", "quantity", "discount_rate", "benefit", "late_risk",
    "shipping_distance_km", "weather_risk", "region_late_rate", "region_avg_days", "region_avg_order_value",
]


#: Partial results of the tasks are merged in this many lanes before the last merge.
LANES = 64


def _co_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every pair (a, b) over the rows where both are known: rows, mean of a, squares of a around it, products."""
    known = ~np.isnan(x)
    m = known.astype(float)
    some = m.sum(axis=0)
    shift = np.where(known, x, 0).sum(axis=0) / np.maximum(some, 1)
    v = np.where(known, x - shift, 0)
    n = m.T @ m
    total = v.T @ m
    whole = np.maximum(n, 1)
    return n, total / whole + shift[:, None], (v * v).T @ m - total * total / whole, v.T @ v - total * total.T / whole


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Co-moments of the rows of both; means move by their distance, so nothing large is subtracted."""
    n = one[0] + two[0]
    d = np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0)
    weight = one[0] * two[0] / np.maximum(n, 1)
    mean = np.where(one[0] > 0, one[1], two[1]) + d * two[0] / np.maximum(n, 1)
    return n, mean, one[2] + two[2] + d * d * weight, one[3] + two[3] + d * d.T * weight


def _packed(lane: int, facts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), *[pa.array([list(f.ravel())], pa.list_(pa.float64())) for f in facts]],
                                      names=["lane", "n", "mean", "square", "product"])


def _merge_all(width: int):
    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in table.select(["n", "mean", "square", "product"]).to_pylist():
            facts = tuple(np.array(row[c]).reshape(width, width) for c in ("n", "mean", "square", "product"))
            total = facts if total is None else _merged(total, facts)
        return pa.Table.from_batches([_packed(table["lane"][0].as_py(), total)])

    return merge


def _pair_facts(width: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(c.fill_null(float("nan")), dtype=float) for c in batch.columns], axis=1)
                facts = _co_moments(x)
                total = facts if total is None else _merged(total, facts)
        if total is not None:
            yield _packed(TaskContext.get().partitionId() % LANES, total)

    return collect


def correlation_matrix(df: DataFrame, features: Sequence[str] = CORRELATION_FEATURES) -> DataFrame:
    """Pearson matrix in long form, each pair over the rows where both are known; null where one does not vary.

    Matrix products give the counts, means and co-moments of all pairs of a batch at once. Tasks merge their batches
    and send one record each, so a row costs no record and the shuffle does not depend on the rows. NaN counts as unknown.
    """
    features = [f for f in features if f in df.columns]
    spark, width = df.sparkSession, len(features)
    kind = "lane int, n array<double>, mean array<double>, square array<double>, product array<double>"
    parts = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).mapInArrow(_pair_facts(width), kind)
    lanes = parts.groupBy("lane").applyInArrow(_merge_all(width), kind).withColumn("lane", F.lit(0))
    whole = lanes.groupBy("lane").applyInArrow(_merge_all(width), kind)
    cells = whole.select(F.posexplode(F.arrays_zip("square", "product")).alias("at", "c"), "square")
    a, b = F.floor(F.col("at") / width).cast("int"), (F.col("at") % width).cast("int")
    other = F.get("square", b * width + a)
    names = F.array(*[F.lit(f) for f in features])
    spread = F.col("c.square") * other
    r = F.when(a == b, 1.0).when(spread > 0, F.col("c.product") / F.sqrt(spread))
    found = cells.select(F.get(names, a).alias("feature_a"), F.get(names, b).alias("feature_b"), r.alias("r"))
    every = spark.range(1).select(F.explode(names).alias("feature_a")).withColumn("feature_b", F.explode(names))
    return every.join(found, ["feature_a", "feature_b"], "left").withColumn("r", F.when(F.col("feature_a") == F.col("feature_b"), 1.0).otherwise(F.col("r")))


def crosstab(df: DataFrame, column: str, levels: Sequence[str], share: bool = False, k: int = 10) -> DataFrame:
    """Counts (or row percentages) of a column's levels per region, for the k largest regions."""
    wide = _in_top(df, k).groupBy(REGION).pivot(column, list(levels)).count().fillna(0)
    if not share:
        return wide
    total = sum((F.col(f"`{v}`") for v in levels), F.lit(0))
    return wide.select(REGION, *[(F.col(f"`{v}`") / total * 100).alias(v) for v in levels])


def cluster_profiles(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    names = [c for c in ("sales", "late_risk", "days_real", "shipping_distance_km") if c in df.columns]
    return df.groupBy(label).agg(*[F.avg(c).alias(f"avg_{c}") for c in names], F.count(F.lit(1)).alias("count"))


def cluster_metrics(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Stability measures per cluster."""
    mean_qty = F.avg("quantity")
    base = df.groupBy(label).agg(
        F.when(mean_qty > 0, F.stddev_samp("quantity") / mean_qty).otherwise(F.lit(1.0)).alias("demand_cv"),
        F.avg("late_risk").alias("late_rate"),
        F.count("order_id").alias("order_count"),
        F.stddev_samp("profit").alias("profit_std"),
        F.avg("profit").alias("profit_mean"),
        F.avg("sales").alias("avg_sales"),
        F.avg(X.cancel_flag()).alias("cancel_rate"),
    ).withColumn("profit_cv", F.col("profit_std") / F.greatest(F.abs("profit_mean"), F.lit(0.01)))
    for source, name in (("order_region", "dominant_region"), ("market", "dominant_market")):
        base = base.join(dominant(df, label, source, name), label, "left")
    return base


def regional_cancel_rate(df: DataFrame, key: str = "order_region") -> DataFrame:
    return df.groupBy(key).agg(F.avg(X.cancel_flag()).alias("regional_cancel_rate"))


def insight_hotspots(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return df.groupBy(REGION).agg(F.avg("late_risk").alias("late_rate")).where(F.col("late_rate") > limit) \
        .orderBy(F.desc("late_rate"), REGION)


def insight_top_share(df: DataFrame, k: int = 3) -> DataFrame:
    """The k best-selling regions and their joint share of all sales."""
    regions = df.groupBy(REGION).agg(F.sum("sales").alias("total_sales"))
    whole = W.partitionBy(F.lit(0))
    best = regions.withColumn("_all", F.sum("total_sales").over(whole)) \
        .orderBy(F.desc("total_sales"), REGION).limit(k)
    return best.select(
        REGION, "total_sales", (F.sum("total_sales").over(whole) / F.col("_all") * 100).alias("joint_share_pct")
    )


def insight_fast_slow(df: DataFrame) -> DataFrame:
    days = df.groupBy(REGION).agg(F.avg("days_real").alias("avg_days"))
    return days.agg(
        F.min_by(REGION, F.struct("avg_days", REGION)).alias("fastest"), F.min("avg_days").alias("fastest_days"),
        F.min_by(REGION, F.struct(-F.col("avg_days"), F.col(REGION))).alias("slowest"),
        F.max("avg_days").alias("slowest_days"),
    )


def distinct_customers(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("customer_id") if approximate else F.count_distinct("customer_id")
    return df.groupBy(REGION, F.to_date("order_date").alias("date")).agg(count.alias("unique_customers"))


def top_routes(df: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent origin-destination pairs."""
    keys = ["customer_country", "order_country"]
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(k)
