"""Geographic, calendar and regional features, encodings and scalings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators.scale import attach
from cargolens.session import cut, sized


def add_macro_region(df: DataFrame) -> DataFrame:
    """Trimmed order region, else market, else 'Unknown', by which column exists."""
    for source in ("order_region", "market"):
        if source in df.columns:
            return df.withColumn("macro_region", F.trim(source))
    return df.withColumn("macro_region", F.lit("Unknown"))


def add_cross_border(df: DataFrame) -> DataFrame:
    if {"customer_country", "order_country"} <= set(df.columns):
        differs = ~F.trim("customer_country").eqNullSafe(F.trim("order_country"))
        unknown = F.col("customer_country").isNull() & F.col("order_country").isNull()
        return df.withColumn("is_cross_border", (differs | unknown).cast("int"))
    return df.withColumn("is_cross_border", F.lit(0))


def dest_centroids(df: DataFrame, key: str = "order_country") -> DataFrame:
    return df.groupBy(key).agg(F.avg("latitude").alias("dest_lat"), F.avg("longitude").alias("dest_lon"))


def add_distance(df: DataFrame, key: str = "order_country") -> DataFrame:
    """Great-circle distance from the order's place to the mean place of its country."""
    if not {"latitude", "longitude", key} <= set(df.columns):
        return df.withColumn("shipping_distance_km", F.lit(0.0))
    out = attach(df, dest_centroids(df, key), key)
    return out.withColumn(
        "shipping_distance_km", X.haversine_km("latitude", "longitude", "dest_lat", "dest_lon")
    )


def add_planar_distance(df: DataFrame) -> DataFrame:
    """Flat distance from the mean place of all rows (a one-row subquery)."""
    centre = df.agg(F.struct(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).alias("c")).scalar()
    return df.withColumn(
        "planar_distance_km",
        X.planar_km("latitude", "longitude", centre.getField("lat"), centre.getField("lon")),
    )


def add_geography(df: DataFrame) -> DataFrame:
    return add_cross_border(add_macro_region(add_distance(df)))


def add_calendar(df: DataFrame, date: str = "order_date") -> DataFrame:
    """Month, year, weekday (Monday 0), quarter, weekend, month end, season, weather risk, holiday."""
    if date in df.columns and dict(df.dtypes)[date].split("(")[0] in ("date", "timestamp", "timestamp_ntz"):
        df = df.withColumns({
            "order_month": F.month(date),
            "order_year": F.year(date),
            "order_dayofweek": F.weekday(F.col(date)),
            "order_quarter": F.quarter(date),
            "is_weekend": X.weekend_flag(date),
            "is_month_end": X.month_end_flag(date),
        })
    elif "order_month" not in df.columns:
        df = df.withColumn("order_month", F.lit(1))
    return df.withColumns({
        "season": X.season("order_month"),
        "weather_risk": X.weather_risk("order_month"),
        "holiday_flag": X.holiday_flag("order_month"),
    })


REGIONAL_COLUMNS = [
    "region_late_rate", "region_avg_days", "region_std_days", "region_avg_order_value",
    "region_total_sales", "region_total_orders", "region_avg_discount",
]


def _regional_measures(have: set[str]) -> list[Column]:
    aggs: list[Column] = []
    if "late_risk" in have:
        aggs.append(F.avg("late_risk").alias("region_late_rate"))
    if "days_real" in have:
        aggs += [F.avg("days_real").alias("region_avg_days"), F.stddev_samp("days_real").alias("region_std_days")]
    if "sales" in have:
        aggs += [F.avg("sales").alias("region_avg_order_value"), F.sum("sales").alias("region_total_sales"),
                 F.count("sales").alias("region_total_orders")]
    if "discount_rate" in have:
        aggs.append(F.avg("discount_rate").alias("region_avg_discount"))
    return aggs


def regional_stats(df: DataFrame, key: str = "macro_region") -> DataFrame:
    """Per region: late rate, shipping days mean and deviation, sales mean, sum and count, mean discount."""
    return df.groupBy(key).agg(*_regional_measures(set(df.columns)))


def regional_stats_ext(df: DataFrame, key: str = "macro_region") -> DataFrame:
    """Wider regional profile: exact median days, longest distance, late deviation, main segment."""
    from cargolens.operators.scale import dominant, exact_quantiles

    base = df.groupBy(key).agg(
        F.avg("late_risk").alias("late_mean"), F.stddev_samp("late_risk").alias("late_std"),
        F.avg("shipping_distance_km").alias("distance_mean"), F.max("shipping_distance_km").alias("distance_max"),
        F.avg("order_item_total").alias("total_mean"), F.sum("order_item_total").alias("total_sum"),
    )
    medians = exact_quantiles(df, ["days_real"], {"days_median": 0.5}, [key]).drop("column")
    segments = dominant(df, key, "customer_segment", "main_segment")
    return base.join(medians, key, "left").join(segments, key, "left")


def add_regional(df: DataFrame, key: str = "macro_region", train: Column | None = None) -> DataFrame:
    """Regional statistics on every row.

    By default they are taken over all rows, the row itself included, so rates leak the target.
    Give ``train`` (a row predicate) to take them from the training rows only.
    """
    base = df if train is None else df.where(train)
    return attach(df, regional_stats(base, key), key)


def build_features(df: DataFrame) -> DataFrame:
    """The full feature table: geography, calendar and regional aggregates.

    The rows are written once, so the joins behind ``df`` run a single time, however often the table is read.
    Country centres and regional statistics come out of one pass over them (grouping sets).
    """
    if not {"order_country", "latitude", "longitude"} <= set(df.columns):
        return add_regional(add_calendar(add_geography(df)))
    base = add_calendar(add_cross_border(add_macro_region(cut(df))))
    measures = _regional_measures(set(base.columns))
    both = sized(base.groupingSets([["order_country"], ["macro_region"]], "order_country", "macro_region").agg(
        F.grouping("order_country").alias("_by_region"), F.avg("latitude").alias("dest_lat"),
        F.avg("longitude").alias("dest_lon"), *measures))
    centres = both.where("_by_region = 0").select("order_country", "dest_lat", "dest_lon")
    regions = both.where("_by_region = 1").select("macro_region", *[c for c in REGIONAL_COLUMNS if c in both.columns])
    out = base.join(centres, "order_country", "left").join(regions, "macro_region", "left")
    return out.withColumn("shipping_distance_km", X.haversine_km("latitude", "longitude", "dest_lat", "dest_lon"))


# --- Encodings and scalings --------------------------------------------------------------


def level_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored encoder: (column, level, code) with codes in sorted level order, from 0."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns
    ]))).where(F.col("level").isNotNull()).distinct()
    return pairs.withColumn("code", F.row_number().over(W.partitionBy("column").orderBy("level")) - 1)


def add_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, suffix: str = "_code") -> DataFrame:
    """Apply a stored encoder; a level it does not know, or a null, gets -1."""
    codes = sized(codes)
    for c in columns:
        one = codes.where(F.col("column") == c).select(
            F.col("level").alias(f"_{c}_level"), F.col("code").alias(f"_{c}_code")
        )
        df = df.join(one, F.col(c).cast("string") == F.col(f"_{c}_level"), "left")
        df = df.withColumn(c + suffix, F.coalesce(F.col(f"_{c}_code"), F.lit(-1))).drop(f"_{c}_level", f"_{c}_code")
    return df


def add_label_codes(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    return add_codes(df, columns, level_codes(df, columns), suffix)


def sorted_levels(df: DataFrame, column: str) -> list[str]:
    """Levels of a categorical column in order. Each becomes a column of its own, so the plan's width bounds their number."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def one_hot_drop_first(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None
) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """0/1 columns for all levels but the first in sorted order; returns frame, new columns, levels."""
    levels = {c: list(levels[c]) if levels else sorted_levels(df, c) for c in columns}
    added = {
        f"{c}_{v}".replace(" ", "_").replace(".", "_"): F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
        for c in columns for v in levels[c][1:]
    }
    return df.withColumns(added) if added else df, list(added), levels


MOMENTS = {"mean": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max}


def with_moments(df: DataFrame, columns: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """The asked moments (``MOMENTS``) of each column as a struct ``_m`` on every row.

    The one row of moments is joined: as a subquery it would be computed anew wherever an expression names it.
    """
    parts = [MOMENTS[k](c).alias(f"{c}_{k}") for c in columns for k in kinds]
    return df.crossJoin(F.broadcast(df.agg(F.struct(*parts).alias("_m"))))


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    df, m = with_moments(df, columns, ("mean", "sd")), F.col("_m")
    return df.withColumns({
        c + suffix: F.coalesce(X.ratio(F.col(c) - m.getField(f"{c}_mean"), m.getField(f"{c}_sd")),
                               (F.col(c) - m.getField(f"{c}_mean")).cast("double"))
        for c in columns
    }).drop("_m")


def minmax_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled", constant: float = 0.5) -> DataFrame:
    """Scale to 0..1; a constant column becomes ``constant``."""
    df, m = with_moments(df, columns, ("min", "max")), F.col("_m")
    return df.withColumns({
        c + suffix: F.when(m.getField(f"{c}_max") > m.getField(f"{c}_min"),
                           (F.col(c) - m.getField(f"{c}_min"))
                           / (m.getField(f"{c}_max") - m.getField(f"{c}_min")))
        .when(F.col(c).isNotNull(), F.lit(constant))
        for c in columns
    }).drop("_m")
