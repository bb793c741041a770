"""Queries for panels, sequences, splits and quarterly drift."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import features, panel
from cargolens.plans.inputs import items, regional, regional_written
from cargolens.plans.registry import query
from cargolens.plans.sql import OI, PANEL, R, REG

DATE = "date::VARCHAR AS date"


def daily(spark, sf):
    return panel.regional_daily_panel(regional(spark, sf, "order_date", "sales", "quantity", "late_risk", "customer_id"))


def _out(df, *columns, date="date"):
    return df.select(*[F.col(c).cast("string").alias(c) if c == date else c for c in columns])


@query("regional_daily_panel", f"""
WITH {PANEL} SELECT macro_region, {DATE}, {R('sales', 2)} AS sales, quantity, {R('late_risk')} AS late_risk, unique_customers FROM panel""")
def q_daily(spark, sf):
    out = daily(spark, sf).withColumns({"sales": X.rnd("sales", 2), "late_risk": X.rnd("late_risk", 6)})
    return _out(out, "macro_region", "date", "sales", "quantity", "late_risk", "unique_customers")


@query("sales_lags", f"""
WITH {PANEL} SELECT macro_region, {DATE}, """ + ", ".join(
    f"{R(f'lag({c}, {n}) OVER w', 2)} AS {c}_lag_{n}" for n in panel.LAGS for c in ("sales", "quantity")) +
    " FROM panel WINDOW w AS (PARTITION BY macro_region ORDER BY date)")
def q_lags(spark, sf):
    names = [f"{c}_lag_{n}" for n in panel.LAGS for c in ("sales", "quantity")]
    out = panel.add_lags(daily(spark, sf))
    return _out(out.withColumns({c: X.rnd(c, 2) for c in names}), "macro_region", "date", *names)


@query("sales_rolls", f"""
WITH {PANEL} SELECT macro_region, {DATE}, {R('avg(sales) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 3)} AS sales_roll_7,
 {R('avg(sales) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 3)} AS sales_roll_30 FROM panel WINDOW w AS (PARTITION BY macro_region ORDER BY date)""")
def q_rolls(spark, sf):
    out = panel.add_rolls(daily(spark, sf))
    return _out(out.withColumns({c: X.rnd(c, 3) for c in ("sales_roll_7", "sales_roll_30")}), "macro_region", "date", "sales_roll_7", "sales_roll_30")


LAB = ", lab AS (SELECT *, (order_id % 3 + store_id % 2)::INT AS kmeans_cluster FROM oi)"
DOM = LAB + """, dom AS (SELECT macro_region, kmeans_cluster AS geographic_cluster, row_number() OVER (PARTITION BY macro_region
 ORDER BY count(*) DESC, kmeans_cluster) AS r FROM lab GROUP BY 1, 2)"""


def rule_labels(df):
    return df.withColumn("kmeans_cluster", (F.col("order_id") % 3 + F.col("store_id") % 2).cast("int"))


@query("dominant_cluster", f"WITH {OI} {DOM} SELECT macro_region, geographic_cluster FROM dom WHERE r = 1")
def q_dominant(spark, sf):
    return panel.dominant_cluster(rule_labels(regional(spark, sf, "order_id", "store_id")))


@query("panel_merge", f"""
WITH {PANEL} {REG} {DOM} SELECT macro_region, {DATE}, {R('sales', 2)} AS sales, {R('region_late_rate')} AS region_late_rate,
 {R('region_avg_order_value', 4)} AS region_avg_order_value, geographic_cluster, (isodow(date)-1)::INT AS dayofweek, month(date)::INT AS month,
 (last_day(date)=date)::INT AS is_month_end FROM panel JOIN reg USING (macro_region) JOIN dom USING (macro_region) WHERE r = 1""")
def q_panel_merge(spark, sf):
    base = regional_written(spark, sf, "order_id", "store_id", "order_date", "sales", "quantity", "late_risk", "customer_id", "days_real", "discount_rate")
    out = panel.build_panel(base, features.regional_stats(base), panel.dominant_cluster(rule_labels(base)))
    out = out.withColumns({"sales": X.rnd("sales", 2), "region_late_rate": X.rnd("region_late_rate", 6),
                           "region_avg_order_value": X.rnd("region_avg_order_value", 4)})
    return _out(out, "macro_region", "date", "sales", "region_late_rate", "region_avg_order_value", "geographic_cluster",
                "dayofweek", "month", "is_month_end")


@query("weekly_panel", f"""
WITH {OI} SELECT CAST(date_trunc('week', order_date) AS DATE)::VARCHAR AS week, order_region, category_name, sum(quantity) AS total_quantity,
 {R('sum(sales)', 2)} AS total_sales, {R('avg(discount_rate)')} AS avg_discount, count(order_id) AS order_count FROM oi GROUP BY 1, 2, 3""")
def q_weekly(spark, sf):
    out = panel.weekly_panel(items(spark, sf, "order_date", "order_region", "category_name", "quantity", "sales", "discount_rate", "order_id"))
    out = out.withColumns({"total_sales": X.rnd("total_sales", 2), "avg_discount": X.rnd("avg_discount", 6)})
    return _out(out, "week", "order_region", "category_name", "total_quantity", "total_sales", "avg_discount", "order_count", date="week")


@query("sliding_sequences", f"""
WITH {OI}, wk AS (SELECT CAST(date_trunc('week', order_date) AS DATE) AS week, order_region, category_name, sum(quantity) AS q,
 avg(discount_rate) AS d, count(order_id) AS n FROM oi GROUP BY 1, 2, 3),
s AS (SELECT *, (q - min(q) OVER ())/(max(q) OVER () - min(q) OVER ()) AS z FROM wk),
f AS (SELECT order_region, category_name, week AS last_week, count(*) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS have,
 lead(z, 4) OVER w AS t4, lead(z, 1) OVER w AS t1, sum(z) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sz,
 sum(d) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS sd, sum(n) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)::DOUBLE AS sn,
 lag(z, 11) OVER w AS z0 FROM s WINDOW w AS (PARTITION BY order_region, category_name ORDER BY week))
SELECT order_region, category_name, last_week::VARCHAR AS last_week, {R('sz', 5)} AS sum_scaled, {R('sd', 5)} AS sum_discount, sn AS sum_orders,
 {R('z0')} AS first_scaled, {R('t1')} AS target_1, {R('t4')} AS target_4 FROM f WHERE have = 12 AND t4 IS NOT NULL""")
def q_sequences(spark, sf):
    weekly = panel.weekly_panel(items(spark, sf, "order_date", "order_region", "category_name", "quantity", "sales", "discount_rate", "order_id"))
    seq = panel.sliding_sequences(weekly)
    total = lambda field: F.aggregate("inputs", F.lit(0.0), lambda a, e: a + e[field])
    out = seq.select(
        "order_region", "category_name", "last_week", X.rnd(total("quantity_scaled"), 5).alias("sum_scaled"),
        X.rnd(total("avg_discount"), 5).alias("sum_discount"), total("order_count").alias("sum_orders"),
        X.rnd(F.col("inputs")[0]["quantity_scaled"], 6).alias("first_scaled"),
        X.rnd(F.col("targets")[0], 6).alias("target_1"), X.rnd(F.col("targets")[3], 6).alias("target_4"))
    return out.withColumn("last_week", F.col("last_week").cast("string"))


@query("temporal_split", f"""
WITH {PANEL} SELECT macro_region, {DATE}, row_number() OVER (ORDER BY date, macro_region) - 1 AS row_index,
 (row_number() OVER (ORDER BY date, macro_region) - 1 < floor(count(*) OVER () * 0.7))::INT AS is_train FROM panel""")
def q_split(spark, sf):
    return _out(panel.temporal_split(daily(spark, sf)), "macro_region", "date", "row_index", "is_train")


@query("walk_forward_folds", f"""
WITH {PANEL}, i AS (SELECT macro_region, date, row_number() OVER (ORDER BY date, macro_region) - 1 AS i, count(*) OVER () AS n FROM panel)
SELECT macro_region, {DATE}, CASE WHEN i >= n - 5*(n//6) THEN ((i - (n - 5*(n//6))) // (n//6) + 1)::INT END AS test_fold FROM i""")
def q_folds(spark, sf):
    return _out(panel.walk_forward_folds(daily(spark, sf)), "macro_region", "date", "test_fold")


QR = OI + """, qa AS (SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS quarter_start, order_region, avg(late_risk) AS late_rate,
 CASE WHEN avg(quantity) > 0 THEN stddev_samp(quantity)/avg(quantity) ELSE 1.0 END AS demand_vol, avg(sales) AS avg_sales, count(order_id) AS order_count
 FROM oi GROUP BY 1, 2),
qr AS (SELECT *, year(quarter_start) || 'Q' || quarter(quarter_start) AS quarter FROM qa
 QUALIFY sum(order_count) OVER (PARTITION BY quarter_start) >= 50 AND count(*) OVER (PARTITION BY quarter_start) >= 5)"""


def quarterly(spark, sf):
    return panel.quarterly_regions(items(spark, sf, "order_date", "order_region", "late_risk", "quantity", "sales", "order_id"))


@query("quarterly_regions", f"""
WITH {QR} SELECT quarter, order_region, {R('late_rate')} AS late_rate, {R('demand_vol')} AS demand_vol, {R('avg_sales', 4)} AS avg_sales, order_count FROM qr""")
def q_quarterly(spark, sf):
    out = quarterly(spark, sf)
    return out.select("quarter", "order_region", X.rnd("late_rate", 6).alias("late_rate"), X.rnd("demand_vol", 6).alias("demand_vol"),
                      X.rnd("avg_sales", 4).alias("avg_sales"), "order_count")


# Labels by rule: regions of a quarter ranked by orders into five groups.
HIST = QR + """, hist AS (SELECT *, ((row_number() OVER (PARTITION BY quarter_start ORDER BY order_count, order_region) - 1) * 5
 // count(*) OVER (PARTITION BY quarter_start))::INT AS cluster_label FROM qr)"""


def history(spark, sf):
    w = W.partitionBy("quarter_start")
    place = F.row_number().over(w.orderBy("order_count", "order_region")) - 1
    return quarterly(spark, sf).withColumn("cluster_label", F.floor(place * 5 / F.count(F.lit(1)).over(w)).cast("int"))


STEPS = HIST + """, st AS (SELECT *, lag(cluster_label) OVER w AS prev, row_number() OVER w - 1 AS i FROM hist
 WINDOW w AS (PARTITION BY order_region ORDER BY quarter_start)),
fl AS (SELECT order_region, count(*) AS n, sum((prev <> cluster_label)::INT)::BIGINT AS ch, regr_slope(late_rate, i) AS tr,
 arg_max(cluster_label, quarter_start) AS lc, arg_max(late_rate, quarter_start) AS lr FROM st GROUP BY 1 HAVING count(*) >= 2)"""


@query("label_changes", f"WITH {STEPS} SELECT order_region, ch AS cluster_changes, {R('ch::DOUBLE/(n-1)')} AS change_rate FROM fl")
def q_changes(spark, sf):
    out = panel.drift_flags(history(spark, sf))
    rate = F.col("cluster_changes") / (F.col("quarters_tracked") - 1)
    return out.select("order_region", "cluster_changes", X.rnd(rate, 6).alias("change_rate"))


@query("late_rate_trend", f"WITH {STEPS} SELECT order_region, round_even(tr, 4) + 0.0 AS late_rate_trend FROM fl")
def q_trend(spark, sf):
    return panel.drift_flags(history(spark, sf)).select("order_region", (F.col("late_rate_trend") + 0.0).alias("late_rate_trend"))


@query("latest_state", f"WITH {STEPS} SELECT order_region, lc AS latest_cluster, round_even(lr, 3) + 0.0 AS latest_late_rate FROM fl")
def q_latest(spark, sf):
    return panel.drift_flags(history(spark, sf)).select("order_region", "latest_cluster", "latest_late_rate")


@query("drift_flags", f"""
WITH {STEPS} SELECT order_region, n AS quarters_tracked, round_even(ch::DOUBLE/(n-1), 3) + 0.0 AS drift_rate, (ch::DOUBLE/(n-1) >= 0.6)::INT AS is_drifting,
 (tr > 0.01)::INT AS worsening FROM fl""")
def q_flags(spark, sf):
    return panel.drift_flags(history(spark, sf)).select(
        "order_region", "quarters_tracked", "drift_rate", "is_drifting", "worsening")


@query("seasonal_decompose", f"""
WITH {OI}, m AS (SELECT macro_region, CAST(date_trunc('month', order_date) AS DATE) AS month_start, sum(sales) AS sales FROM oi GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
 (sum(sales) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(sales, 6) OVER w + lead(sales, 6) OVER w)/2)/12 END AS trend
 FROM m WINDOW w AS (PARTITION BY macro_region ORDER BY month_start)),
e AS (SELECT *, avg(sales - trend) OVER (PARTITION BY macro_region, month(month_start)) AS me FROM t)
SELECT macro_region, month_start::VARCHAR AS month_start, {R('trend', 2)} AS trend, {R('me', 2)} AS month_effect, {R('sales - trend - me', 2)} AS remainder FROM e""")
def q_decompose(spark, sf):
    monthly = regional(spark, sf, "order_date", "sales").groupBy(
        "macro_region", F.to_date(F.date_trunc("month", F.col("order_date"))).alias("month_start")).agg(F.sum("sales").alias("sales"))
    out = panel.seasonal_decompose(monthly)
    return out.select("macro_region", F.col("month_start").cast("string").alias("month_start"),
                      *[X.rnd(c, 2).alias(c) for c in ("trend", "month_effect", "remainder")])
