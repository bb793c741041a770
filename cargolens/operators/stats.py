"""Hypothesis tests. Each is one pass of sums; p-values finish the one-row result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.functions.pvalues import chi2_pvalue, f_pvalue, normal_quantile, t_pvalue
from cargolens.operators.scale import exact_quantiles, running_totals

REGION = "macro_region"


def anova_oneway(df: DataFrame, value: str = "days_real", group: str = REGION) -> DataFrame:
    """F over groups with two or more values."""
    v = F.col(value).cast("double")
    groups = df.where(v.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2")
    ).where("n >= 2")
    t = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum(F.col("n") * F.col("s2")).alias("within"),
    ).where("k >= 2")
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    out = t.select(X.ratio(between / df1, F.col("within") / df2).alias("f_statistic"), df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p_value", f_pvalue("f_statistic", "df1", "df2"))


def chi_square(df: DataFrame, row: str = REGION, column: str = "late_risk") -> DataFrame:
    """Independence test of a contingency table; continuity correction only for one degree of freedom."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(
        F.count(F.lit(1)).alias("o")
    )
    rows = cells.groupBy(row).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(column).agg(F.sum("o").alias("c"))
    shape = rows.agg(F.struct(F.count(F.lit(1)).alias("nr"), F.sum("r").alias("n")).alias("s")).scalar()
    width = cols.agg(F.struct(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("inv")).alias("s")).scalar()
    inv_rows = rows.agg(F.sum(1 / F.col("r"))).scalar()
    n = shape.getField("n")
    dof = (shape.getField("nr") - 1) * (width.getField("nc") - 1)
    expected = F.col("r") * F.col("c") / n
    gap = F.abs(F.col("o") - expected)
    # A cell without rows adds its expected count; all cells together expect n, so add what is missing.
    t = cells.join(rows, row).join(cols, column).agg(
        F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("covered"), F.max(gap).alias("gap"),
        F.max(n).alias("n"), F.max(dof).alias("dof"), F.max(inv_rows * width.getField("inv")).alias("inv"),
    )
    # In a 2 x 2 table all four gaps are equal, and the inverse expected counts sum to n * inv.
    shrunk = F.col("gap") - F.least(F.col("gap"), F.lit(0.5))
    chi2 = F.when(F.col("dof") == 1, shrunk * shrunk * F.col("n") * F.col("inv")) \
        .otherwise(F.col("seen") + F.col("n") - F.col("covered"))
    out = t.select(chi2.alias("chi2"), F.col("dof").cast("double").alias("dof"))
    return out.withColumn("p_value", chi2_pvalue("chi2", "dof"))


def kruskal_wallis(df: DataFrame, value: str = "sales", group: str = REGION) -> DataFrame:
    """H with mid-ranks and tie correction; ranks come from value counts, not from a global sort of rows."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(group, v.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(group).agg(F.sum("c").alias("_size")).where("_size >= 2").select(group)
    ranked = running_totals(counts.join(sizes, group, "left_semi"), "_v", {"n": "c"})
    mid = F.col("n_before") + (F.col("n_ties") + 1) / 2
    tie = F.col("n_ties").cast("double")
    per_group = ranked.groupBy(group).agg(
        F.sum(F.col("c") * mid).alias("rank_sum"), F.sum("c").alias("n"), F.max("n_all").alias("total"),
        F.sum(F.col("c") * (tie * tie - 1)).alias("tie_part"),
    )
    t = per_group.agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.max("total").cast("double").alias("n"),
        F.count(F.lit(1)).alias("k"), F.sum("tie_part").alias("ties"),
    ).where("k >= 2")
    n = F.col("n")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = 1 - F.col("ties") / (n * n * n - n)
    out = t.select(X.ratio(h, correction).alias("h_statistic"), (F.col("k") - 1).cast("double").alias("dof"))
    return out.withColumn("p_value", chi2_pvalue("h_statistic", "dof"))


def pearson_test(df: DataFrame, x: str = "shipping_distance_km", y: str = "days_real") -> DataFrame:
    """Correlation of rows with positive x; no result for ten rows or fewer."""
    t = df.where((F.col(x) > 0) & F.col(y).isNotNull()).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).cast("double").alias("n")
    ).where("n > 10")
    r, dof = F.col("r"), F.col("n") - 2
    out = t.select("r", "n", (r * F.sqrt(dof / (1 - r * r))).alias("_t"), dof.alias("_dof"))
    return out.select("r", "n", t_pvalue("_t", "_dof").alias("p_value"))


def t_test(df: DataFrame, value: str = "days_real", flag: str = "is_weekend") -> DataFrame:
    """Equal-variance t of flagged against other rows; both arms need more than ten values."""
    v = F.col(value).cast("double")

    def arm(k: int):
        c = F.when(F.col(flag) == k, v)
        return F.count(c).cast("double").alias(f"n{k}"), F.avg(c).alias(f"m{k}"), F.var_samp(c).alias(f"s{k}")

    t = df.agg(*arm(1), *arm(0)).where("n1 > 10 and n0 > 10")
    dof = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0")) / dof
    stat = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))
    out = t.select(stat.alias("t_statistic"), dof.alias("dof"), F.col("m1").alias("mean_weekend"), F.col("m0").alias("mean_weekday"))
    return out.withColumn("p_value", t_pvalue("t_statistic", "dof"))


# --- Residuals and stability -------------------------------------------------------------


def residual_stats(scored: DataFrame, actual: str = "y", predicted: str = "prediction") -> DataFrame:
    """Mean, population deviation, skewness and excess kurtosis of the residuals."""
    e = F.col(actual) - F.col(predicted)
    return scored.agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"),
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value (or given limits)."""
    if low is None or high is None:
        span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
        lo, hi = span.getField("lo").cast("double"), span.getField("hi").cast("double")
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by, X.bin_index(value, lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.min(value).alias("smallest"), F.max(value).alias("largest")
    )


def residual_histogram(scored: DataFrame, bins: int = 60, actual: str = "y", predicted: str = "prediction") -> DataFrame:
    return histogram(scored.select((F.col(actual) - F.col(predicted)).alias("residual")), "residual", bins)


TIES_AT_ONCE = 4096


def qq_points(scored: DataFrame, actual: str = "y", predicted: str = "prediction") -> DataFrame:
    """Ordered residuals against normal quantiles at the uniform order-statistic medians."""
    e = scored.select((F.col(actual) - F.col(predicted)).alias("residual")).where("residual is not null")
    counts = e.groupBy("residual").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_totals(counts, "residual", {"n": "c"})
    # Ranks of a value with many ties are written out in stretches, dealt over all tasks.
    begins = F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("n_ties"), F.lit(TIES_AT_ONCE).cast("bigint"))
    stretches = ranked.select("residual", F.col("n_all").cast("double").alias("n"), (F.col("n_before") + F.col("n_ties")).alias("last"), F.explode(begins).alias("begin")) \
        .repartition("begin")
    upto = F.least(F.col("last"), F.col("begin") + (TIES_AT_ONCE - 1))
    each = stretches.select("residual", "n", F.explode(F.sequence(F.col("begin"), upto)).alias("rank"))
    tail = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("rank") == 1, 1 - tail).when(F.col("rank") == F.col("n"), tail) \
        .otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))
    return each.select("rank", "residual", p.alias("p")).withColumn("normal_quantile", normal_quantile("p"))


def iqr_stability(perf: DataFrame, metric: str = "mae", high_is_bad: bool = True, key: str = "region") -> DataFrame:
    """Every region with the 1.5-box fences of a metric, an outlier flag and the coefficient of variation."""
    fences = exact_quantiles(perf, [metric], {"q1": 0.25, "q3": 0.75})
    box = fences.select(F.struct("q1", "q3").alias("b")).scalar()
    spread = perf.agg(F.struct(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s")).alias("v")).scalar()
    q1, q3 = box.getField("q1"), box.getField("q3")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    cv = F.coalesce(X.ratio(spread.getField("s"), spread.getField("m")), F.lit(0.0))
    bad = F.col(metric) > high if high_is_bad else F.col(metric) < low
    return perf.select(
        key, metric, low.alias("lower_fence"), high.alias("upper_fence"), bad.cast("int").alias("is_outlier"),
        cv.alias("cv"), F.when(cv > 0.4, "INCONSISTENT").otherwise("CONSISTENT").alias("verdict"),
    )


def distribution_shift(df: DataFrame, value: str = "days_real", region: str = "order_region") -> DataFrame:
    """Kolmogorov-Smirnov distance and chi-square of late counts between consecutive quarters of a region.

    Works on counts per (region, quarter, value); the cumulative shares come from bucketed running totals.
    """
    quarter = F.to_date(F.date_trunc("quarter", F.col("order_date"))).alias("quarter_start")
    base = df.select(region, quarter, F.col(value).cast("double").alias("_v"), "late_risk")
    sizes = base.groupBy(region, "quarter_start").agg(
        F.count("_v").alias("n"), F.sum("late_risk").alias("late"), F.count("late_risk").alias("m"))
    w = W.partitionBy(region).orderBy("quarter_start")
    pairs = sizes.select(
        region, "quarter_start", F.lag("quarter_start").over(w).alias("previous"), F.col("n").alias("n1"),
        F.lag("n").over(w).alias("n0"), F.col("late").alias("a1"), F.lag("late").over(w).alias("a0"),
        F.col("m").alias("m1"), F.lag("m").over(w).alias("m0"),
    ).where("previous is not null")
    counts = base.where("_v is not null").groupBy(region, "quarter_start", "_v").agg(F.count(F.lit(1)).alias("c"))
    # Each quarter's counts take part twice: as the later and as the earlier member of a pair.
    later = counts.select(region, "quarter_start", "_v", F.col("c").alias("c1"), F.lit(0).cast("bigint").alias("c0"))
    earlier = counts.withColumnRenamed("quarter_start", "previous").join(
        pairs.select(region, "quarter_start", "previous"), [region, "previous"]
    ).select(region, "quarter_start", "_v", F.lit(0).cast("bigint").alias("c1"), F.col("c").alias("c0"))
    merged = later.unionByName(earlier).groupBy(region, "quarter_start", "_v").agg(
        F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    cum = running_totals(merged, "_v", {"x": "c1", "y": "c0"}, [region, "quarter_start"])
    gap = F.abs((F.col("x_before") + F.col("x_ties")) / F.col("x_all") - (F.col("y_before") + F.col("y_ties")) / F.col("y_all"))
    ks = cum.where("y_all > 0").groupBy(region, "quarter_start").agg(F.max(gap).alias("ks_distance"))
    total = F.col("m1") + F.col("m0")
    late = F.col("a1") + F.col("a0")
    cross = F.col("a1") * (F.col("m0") - F.col("a0")) - F.col("a0") * (F.col("m1") - F.col("a1"))
    corrected = F.greatest(F.abs(cross) - total / 2, F.lit(0.0))
    # As doubles: a product of four counts outgrows a long from some 50,000 rows a quarter.
    chi2 = X.ratio(total * corrected * corrected, late.cast("double") * (total - late) * F.col("m1") * F.col("m0"))
    return pairs.join(ks, [region, "quarter_start"]).select(
        region, "quarter_start", "ks_distance", chi2.alias("late_chi2")
    )


