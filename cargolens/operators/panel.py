"""Regional panels over time: daily and weekly aggregates, lags, sequences, splits, drift measures.

The panels are aggregated by calendar period first. A window partition then holds one row per
period of one region, so it is bounded by the calendar, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators.scale import attach, dominant
from cargolens.session import sized

REGION = "macro_region"
LAGS = (1, 7, 14, 30)
ROLLS = (7, 30)

FORECAST_FEATURES = [
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_30", "quantity_lag_1", "quantity_lag_7",
    "sales_roll_7", "sales_roll_30", "dayofweek", "month", "quarter", "is_weekend", "is_month_end",
    "late_risk", "region_late_rate", "region_avg_order_value", "geographic_cluster",
]


def regional_daily_panel(df: DataFrame) -> DataFrame:
    """Region x day: sales, quantity, late rate, distinct customers. Days without orders have no row."""
    return df.groupBy(REGION, F.to_date("order_date").alias("date")).agg(
        F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"),
        F.avg("late_risk").alias("late_risk"), F.count_distinct("customer_id").alias("unique_customers"),
    )


def add_lags(panel: DataFrame, lags: Sequence[int] = LAGS, columns: Sequence[str] = ("sales", "quantity")) -> DataFrame:
    """Values n rows (not days) earlier in the same region."""
    w = W.partitionBy(REGION).orderBy("date")
    return panel.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(w) for n in lags for c in columns})


def add_rolls(panel: DataFrame, rolls: Sequence[int] = ROLLS, leak_free: bool = False) -> DataFrame:
    """Trailing means of sales over n rows, from the first row on.

    The current row is part of the mean, as in the published features; it is also the target.
    ``leak_free`` shifts the frame one row back.
    """
    shift = 1 if leak_free else 0
    w = W.partitionBy(REGION).orderBy("date")
    return panel.withColumns({
        f"sales_roll_{n}": F.avg("sales").over(w.rowsBetween(-(n - 1) - shift, -shift)) for n in rolls
    })


def add_panel_calendar(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        "dayofweek": F.weekday(F.col("date")), "month": F.month("date"), "quarter": F.quarter("date"),
        "is_weekend": X.weekend_flag("date"), "is_month_end": X.month_end_flag("date"),
    })


def dominant_cluster(df: DataFrame, label: str = "kmeans_cluster") -> DataFrame:
    return dominant(df, REGION, label, "geographic_cluster")


def merge_panel(panel: DataFrame, stats: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Regional statistics and the region's main cluster (0 when unknown) on every panel row."""
    if stats is not None:
        panel = attach(panel, stats, REGION)
    if clusters is not None:
        panel = attach(panel, clusters, REGION)
        panel = panel.withColumn("geographic_cluster", F.coalesce("geographic_cluster", F.lit(0)).cast("int"))
    return panel


def build_panel(df: DataFrame, stats: DataFrame | None = None, clusters: DataFrame | None = None,
                leak_free: bool = False) -> DataFrame:
    panel = add_panel_calendar(add_rolls(add_lags(regional_daily_panel(df)), leak_free=leak_free))
    return merge_panel(panel, stats, clusters)


def model_rows(panel: DataFrame, features: Sequence[str] = FORECAST_FEATURES, target: str = "sales") -> DataFrame:
    """Rows with every feature known: the first 30 rows of a region have no full lags."""
    return panel.dropna(subset=[c for c in [*features, target] if c in panel.columns])


def time_index(panel: DataFrame) -> DataFrame:
    """Position of each panel row in (date, region) order and the number of rows.

    Days are counted first: the running total runs over one row per calendar day, and only the rows
    of one day are ordered by region.
    """
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    calendar = W.partitionBy(F.lit(0)).orderBy("date")
    days = days.select(
        "date",
        F.coalesce(F.sum("_n").over(calendar.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(F.lit(0))).alias("rows_total"),
    )
    inside = F.row_number().over(W.partitionBy("date").orderBy(REGION)) - 1
    return panel.withColumn("_inside", inside).join(days, "date") \
        .withColumn("row_index", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def temporal_split(panel: DataFrame, train_share: float = 0.7) -> DataFrame:
    """Mark the first share of all rows by date as training rows."""
    out = time_index(panel)
    border = F.floor(F.col("rows_total") * F.lit(train_share))
    return out.withColumn("is_train", (F.col("row_index") < border).cast("int"))


def regional_split(panel: DataFrame, train_share: float = 0.7) -> DataFrame:
    """The same split inside every region."""
    w = W.partitionBy(REGION)
    out = panel.withColumn("_i", F.row_number().over(w.orderBy("date")) - 1) \
        .withColumn("region_rows", F.count(F.lit(1)).over(w))
    border = F.floor(F.col("region_rows") * F.lit(train_share))
    return out.withColumn("region_train_rows", border) \
        .withColumn("is_train", (F.col("_i") < border).cast("int")).drop("_i")


def walk_forward_folds(panel: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding folds: adds ``test_fold`` (1..folds), null for rows that only ever train.

    Fold f trains on every row before its test block, which is what ``row_index`` is kept for.
    """
    out = time_index(panel)
    size = F.floor(F.col("rows_total") / (folds + 1))
    first = F.col("rows_total") - size * folds
    fold = (F.floor((F.col("row_index") - first) / size) + 1).cast("int")
    return out.withColumn("test_fold", F.when(F.col("row_index") >= first, fold))


def weekly_panel(df: DataFrame) -> DataFrame:
    """Week (from Monday) x region x category."""
    return df.groupBy(
        F.to_date(F.date_trunc("week", F.col("order_date"))).alias("week"), "order_region", "category_name"
    ).agg(
        F.sum("quantity").alias("total_quantity"), F.sum("sales").alias("total_sales"),
        F.avg("discount_rate").alias("avg_discount"), F.count("order_id").alias("order_count"),
    )


def sliding_sequences(weekly: DataFrame, length: int = 12, horizon: int = 4) -> DataFrame:
    """Every full window of ``length`` weeks with the scaled quantities of the next ``horizon`` weeks.

    A group shorter than ``length + horizon`` yields nothing. Inputs are (scaled quantity, mean
    discount, order count) per week.
    """
    lo_hi = weekly.agg(F.struct(F.min("total_quantity").alias("lo"), F.max("total_quantity").alias("hi")).alias("b")).scalar()
    lo, hi = lo_hi.getField("lo"), lo_hi.getField("hi")
    scaled = F.when(hi > lo, (F.col("total_quantity") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    w = W.partitionBy("order_region", "category_name").orderBy("week")
    step = F.struct(F.col("quantity_scaled"), F.col("avg_discount"), F.col("order_count").cast("double").alias("order_count"))
    return (
        weekly.withColumn("quantity_scaled", scaled)
        .select(
            "order_region", "category_name", F.col("week").alias("last_week"),
            F.collect_list(step).over(w.rowsBetween(-(length - 1), 0)).alias("inputs"),
            F.collect_list("quantity_scaled").over(w.rowsBetween(1, horizon)).alias("targets"),
        )
        .where((F.size("inputs") == length) & (F.size("targets") == horizon))
    )


# --- Quarterly drift ---------------------------------------------------------------------


def quarterly_regions(df: DataFrame, clusters: int = 5, region: str = "order_region") -> DataFrame:
    """Quarter x region measures; quarters with too few orders or regions are skipped."""
    mean_qty = F.avg("quantity")
    out = df.groupBy(F.to_date(F.date_trunc("quarter", F.col("order_date"))).alias("quarter_start"), region).agg(
        F.avg("late_risk").alias("late_rate"),
        F.when(mean_qty > 0, F.stddev_samp("quantity") / mean_qty).otherwise(F.lit(1.0)).alias("demand_vol"),
        F.avg("sales").alias("avg_sales"), F.count("order_id").alias("order_count"), F.count(F.lit(1)).alias("_rows"),
    )
    whole = W.partitionBy("quarter_start")
    return (
        out.withColumn("_all", F.sum("_rows").over(whole)).withColumn("_regions", F.count(F.lit(1)).over(whole))
        .where((F.col("_all") >= clusters * 10) & (F.col("_regions") >= clusters))
        .withColumn("quarter", X.quarter_label("quarter_start"))
        .drop("_rows", "_all", "_regions")
    )


def drift_flags(history: DataFrame, threshold: float = 0.6, worse: float = 0.01, region: str = "order_region") -> DataFrame:
    """Label changes, late-rate slope and latest state per region over its tracked quarters (2 or more).

    Flags use the unrounded numbers.
    """
    w = W.partitionBy(region).orderBy("quarter_start")
    steps = history.withColumn("_prev", F.lag("cluster_label").over(w)) \
        .withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    out = steps.groupBy(region).agg(
        F.count(F.lit(1)).alias("quarters_tracked"),
        F.sum(F.when(F.col("_prev") != F.col("cluster_label"), 1).otherwise(0)).alias("cluster_changes"),
        F.regr_slope("late_rate", "_i").alias("_trend"),
        F.max_by("cluster_label", "quarter_start").alias("latest_cluster"),
        F.max_by("late_rate", "quarter_start").alias("_latest"),
    ).where(F.col("quarters_tracked") >= 2)
    rate = F.col("cluster_changes") / (F.col("quarters_tracked") - 1)
    return out.select(
        region, "quarters_tracked", "cluster_changes", F.bround(rate, 3).alias("drift_rate"),
        (rate >= threshold).cast("int").alias("is_drifting"), F.bround("_trend", 4).alias("late_rate_trend"),
        (F.col("_trend") > worse).cast("int").alias("worsening"), "latest_cluster",
        F.bround("_latest", 3).alias("latest_late_rate"),
    )


def seasonal_decompose(monthly: DataFrame, value: str = "sales", period: int = 12) -> DataFrame:
    """Per region: centred moving mean, mean effect of the calendar month, remainder.

    ``monthly`` has (macro_region, month_start, value). The centred frame of an even period gives its
    two end points half weight; the trend is null where the frame is not full.
    """
    half = period // 2
    w = W.partitionBy(REGION).orderBy("month_start")
    wide, inner = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
    ends = F.sum(value).over(wide) - F.sum(value).over(inner)
    mean = (F.sum(value).over(inner) + ends / 2) / period
    if period % 2:
        mean = F.avg(value).over(wide)
    full = F.count(value).over(wide) == 2 * half + 1
    trended = monthly.withColumn("trend", F.when(full, mean)).withColumn("month", F.month("month_start"))
    effect = F.avg(F.col(value) - F.col("trend")).over(W.partitionBy(REGION, "month"))
    out = trended.withColumn("month_effect", effect)
    return out.withColumn("remainder", F.col(value) - F.col("trend") - F.col("month_effect"))
