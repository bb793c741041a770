"""Queries for regional reports, cross tables and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import aggregate, features
from cargolens.plans.inputs import feature_table, items, regional, regional_written
from cargolens.plans.registry import query
from cargolens.plans.sql import FEAT, GEO, OI, R

RG = "macro_region"
TOP = "top AS (SELECT macro_region FROM oi GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"


def _round(df, places, *names):
    return df.withColumns({n: X.rnd(n, places) for n in names})


@query("regional_stats", f"""
WITH {OI} SELECT macro_region, {R('avg(late_risk)')} AS region_late_rate, {R('avg(days_real)')} AS region_avg_days,
 {R('stddev_samp(days_real)')} AS region_std_days, {R('avg(sales)', 4)} AS region_avg_order_value, {R('sum(sales)', 2)} AS region_total_sales,
 count(sales) AS region_total_orders, {R('avg(discount_rate)')} AS region_avg_discount FROM oi GROUP BY 1""")
def q_regional_stats(spark, sf):
    out = features.regional_stats(regional(spark, sf, "late_risk", "days_real", "sales", "discount_rate"))
    out = _round(out, 6, "region_late_rate", "region_avg_days", "region_std_days", "region_avg_discount")
    return _round(_round(out, 4, "region_avg_order_value"), 2, "region_total_sales")


@query("regional_stats_ext", f"""
WITH {GEO}, seg AS (SELECT macro_region, customer_segment, row_number() OVER (PARTITION BY macro_region ORDER BY count(*) DESC, customer_segment) AS r
 FROM geo GROUP BY 1, 2)
SELECT g.macro_region, {R('avg(late_risk)')} AS late_mean, {R('stddev_samp(late_risk)')} AS late_std, {R('avg(shipping_distance_km)', 3)} AS distance_mean,
 {R('max(shipping_distance_km)', 3)} AS distance_max, {R('avg(order_item_total)', 3)} AS total_mean, {R('sum(order_item_total)', 1)} AS total_sum,
 median(days_real)::DOUBLE AS days_median, any_value(seg.customer_segment) AS main_segment
FROM geo g JOIN seg ON g.macro_region = seg.macro_region AND seg.r = 1 GROUP BY 1""")
def q_regional_ext(spark, sf):
    df = features.add_distance(regional_written(spark, sf, "order_country", "latitude", "longitude", "late_risk", "days_real",
                                        "order_item_total", "customer_segment"))
    out = _round(features.regional_stats_ext(df), 6, "late_mean", "late_std")
    return _round(_round(out, 3, "distance_mean", "distance_max", "total_mean"), 1, "total_sum")


@query("late_rate_by_region", f"""
WITH {OI} SELECT macro_region, {R('avg(late_risk)')} AS late_rate, {R('(SELECT avg(late_risk) FROM oi)')} AS global_rate FROM oi GROUP BY 1""")
def q_late_rate(spark, sf):
    return _round(aggregate.late_rate_by_region(regional(spark, sf, "late_risk")), 6, "late_rate", "global_rate")


@query("sales_by_region", f"""
WITH {OI} SELECT macro_region, {R('sum(sales)', 2)} AS total_sales, {R('avg(sales)', 4)} AS avg_sales, count(sales) AS orders FROM oi GROUP BY 1""")
def q_sales(spark, sf):
    return _round(_round(aggregate.sales_by_region(regional(spark, sf, "sales")), 2, "total_sales"), 4, "avg_sales")


@query("shipping_days_box", f"""
WITH {OI}, {TOP.format(k=15)}, t AS (SELECT oi.* FROM oi JOIN top USING (macro_region)),
q AS (SELECT macro_region, quantile_cont(days_real, 0.25) AS q1, quantile_cont(days_real, 0.5) AS median, quantile_cont(days_real, 0.75) AS q3 FROM t GROUP BY 1)
SELECT macro_region, min(days_real)::BIGINT AS low, min(days_real) FILTER (days_real >= q1-1.5*(q3-q1))::BIGINT AS whisker_low, any_value(q1)::DOUBLE AS q1,
 any_value(median)::DOUBLE AS median, any_value(q3)::DOUBLE AS q3, max(days_real) FILTER (days_real <= q3+1.5*(q3-q1))::BIGINT AS whisker_high,
 max(days_real)::BIGINT AS high, count(*) FILTER (days_real < q1-1.5*(q3-q1) OR days_real > q3+1.5*(q3-q1)) AS outliers FROM t JOIN q USING (macro_region) GROUP BY 1""")
def q_box(spark, sf):
    out = aggregate.shipping_days_box(regional_written(spark, sf, "days_real"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("low", "whisker_low", "whisker_high", "high")})


@query("seasonal_demand", f"""
WITH {OI}, {TOP.format(k=6)} SELECT macro_region, month(order_date)::INT AS order_month, {R('sum(sales)', 2)} AS total_sales
FROM oi JOIN top USING (macro_region) GROUP BY 1, 2""")
def q_seasonal(spark, sf):
    df = regional(spark, sf, "order_date", "sales").withColumn("order_month", F.month("order_date"))
    return _round(aggregate.seasonal_demand(df), 2, "total_sales")


def _corr_sql() -> str:
    fs = aggregate.CORRELATION_FEATURES
    rows = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'corr({a}, {b})', 5)} AS r FROM cf"
            for a in fs for b in fs if a != b]
    rows += [f"SELECT '{a}' AS feature_a, '{a}' AS feature_b, 1.0::DOUBLE AS r" for a in fs]
    return f"WITH {FEAT}, cf AS MATERIALIZED (SELECT {', '.join(fs)} FROM feat) " + " UNION ALL ".join(rows)


@query("correlation_matrix", _corr_sql())
def q_corr(spark, sf):
    return _round(aggregate.correlation_matrix(feature_table(spark, sf)), 5, "r")


STATUSES = ["Advance shipping", "Late delivery", "Shipping canceled", "Shipping on time"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("delivery_status_crosstab", f"""
WITH {OI}, {TOP.format(k=10)} SELECT macro_region, """ + ", ".join(
    R(f"100.0*count(*) FILTER (delivery_status='{s}')/count(*)", 6) + f' AS "{s}"' for s in STATUSES) +
    " FROM oi JOIN top USING (macro_region) GROUP BY 1")
def q_delivery(spark, sf):
    return _round(aggregate.crosstab(regional(spark, sf, "delivery_status"), "delivery_status", STATUSES, share=True), 6, *STATUSES)


@query("segment_crosstab", f"""
WITH {OI}, {TOP.format(k=10)} SELECT macro_region, """ + ", ".join(
    f'count(*) FILTER (customer_segment=\'{s}\') AS "{s}"' for s in SEGMENTS) + " FROM oi JOIN top USING (macro_region) GROUP BY 1")
def q_segment(spark, sf):
    return aggregate.crosstab(regional(spark, sf, "customer_segment"), "customer_segment", SEGMENTS)


@query("regional_cancel_rate", f"""
WITH {OI} SELECT order_region, {R("avg((order_status IN ('CANCELED','ON_HOLD'))::INT)")} AS regional_cancel_rate FROM oi GROUP BY 1""")
def q_cancel_rate(spark, sf):
    return _round(aggregate.regional_cancel_rate(items(spark, sf, "order_region", "order_status")), 6, "regional_cancel_rate")


@query("insight_hotspots", f"WITH {OI} SELECT macro_region, {R('avg(late_risk)')} AS late_rate FROM oi GROUP BY 1 HAVING avg(late_risk) > 0.5")
def q_hotspots(spark, sf):
    return _round(aggregate.insight_hotspots(regional(spark, sf, "late_risk")), 6, "late_rate")


@query("insight_top3_share", f"""
WITH {OI}, t AS (SELECT macro_region, sum(sales) AS s FROM oi GROUP BY 1), b AS (SELECT * FROM t ORDER BY s DESC, 1 LIMIT 3)
SELECT macro_region, {R('s', 2)} AS total_sales, {R('(SELECT sum(s) FROM b)/(SELECT sum(s) FROM t)*100')} AS joint_share_pct FROM b""")
def q_top3(spark, sf):
    return _round(_round(aggregate.insight_top_share(regional(spark, sf, "sales")), 2, "total_sales"), 6, "joint_share_pct")


@query("insight_fast_slow", f"""
WITH {OI}, t AS (SELECT macro_region, avg(days_real) AS d FROM oi GROUP BY 1)
SELECT (SELECT macro_region FROM t ORDER BY d, 1 LIMIT 1) AS fastest, (SELECT {R('min(d)')} FROM t) AS fastest_days,
 (SELECT macro_region FROM t ORDER BY d DESC, 1 LIMIT 1) AS slowest, (SELECT {R('max(d)')} FROM t) AS slowest_days""")
def q_fast_slow(spark, sf):
    return _round(aggregate.insight_fast_slow(regional(spark, sf, "days_real")), 6, "fastest_days", "slowest_days")


@query("distinct_customers", f"""
WITH {OI} SELECT macro_region, CAST(order_date AS DATE)::VARCHAR AS date, count(DISTINCT customer_id) AS unique_customers FROM oi GROUP BY 1, 2""")
def q_distinct(spark, sf):
    return aggregate.distinct_customers(regional(spark, sf, "order_date", "customer_id")).withColumn("date", F.col("date").cast("string"))


@query("top_regions", f"WITH {OI} SELECT macro_region, count(*) AS count FROM oi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_top_regions(spark, sf):
    return aggregate.top_regions(regional(spark, sf), 10)


@query("top_routes", f"WITH {OI} SELECT customer_country, order_country, count(*) AS count FROM oi GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def q_top_routes(spark, sf):
    return aggregate.top_routes(items(spark, sf, "customer_country", "order_country"))


@query("union_results", f"""
WITH {OI} SELECT 'days' AS measure, macro_region, {R('avg(days_real)')} AS value FROM oi GROUP BY 2
UNION ALL SELECT 'late' AS measure, macro_region, {R('avg(late_risk)')} AS value FROM oi GROUP BY 2""")
def q_union(spark, sf):
    """Several result tables stacked: one keyed pass instead of one scan per table."""
    means = regional(spark, sf, "days_real", "late_risk").groupBy(RG).agg(F.avg("days_real").alias("days"), F.avg("late_risk").alias("late"))
    return means.unpivot([RG], ["days", "late"], "measure", "value").withColumn("value", X.rnd("value", 6))


# --- Clusters given labels ---------------------------------------------------------------

LABELLED = OI + ", lab AS (SELECT *, store_id % 5 AS cluster_label FROM oi)"


def labelled(spark, sf, *columns):
    return items(spark, sf, "store_id", *columns).withColumn("cluster_label", F.col("store_id") % 5)


@query("cluster_profiles", f"""
WITH {LABELLED} SELECT cluster_label, {R('avg(sales)', 4)} AS avg_sales, {R('avg(late_risk)')} AS avg_late_risk, {R('avg(days_real)')} AS avg_days_real,
 count(*) AS count FROM lab GROUP BY 1""")
def q_profiles(spark, sf):
    out = aggregate.cluster_profiles(labelled(spark, sf, "sales", "late_risk", "days_real"))
    return _round(_round(out, 4, "avg_sales"), 6, "avg_late_risk", "avg_days_real")


CM = LABELLED + """, cm AS (SELECT cluster_label, CASE WHEN avg(quantity) > 0 THEN stddev_samp(quantity)/avg(quantity) ELSE 1.0 END AS demand_cv,
 avg(late_risk) AS late_rate, count(order_id) AS order_count, stddev_samp(profit) AS profit_std, avg(profit) AS profit_mean, avg(sales) AS avg_sales,
 avg((order_status IN ('CANCELED','ON_HOLD'))::INT) AS cancel_rate, stddev_samp(profit)/greatest(abs(avg(profit)), 0.01) AS profit_cv FROM lab GROUP BY 1),
dr AS (SELECT cluster_label, order_region AS v, row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, order_region) AS r FROM lab GROUP BY 1, 2),
dm AS (SELECT cluster_label, market AS v, row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, market) AS r FROM lab GROUP BY 1, 2)"""


def cluster_metrics(spark, sf):
    return aggregate.cluster_metrics(labelled(spark, sf, "order_id", "quantity", "late_risk", "profit", "sales", "order_status", "order_region", "market"))


@query("cluster_metrics", f"""
WITH {CM} SELECT cluster_label, {R('demand_cv')} AS demand_cv, {R('late_rate')} AS late_rate, order_count, {R('profit_std', 3)} AS profit_std,
 {R('profit_mean', 4)} AS profit_mean, {R('avg_sales', 4)} AS avg_sales, {R('cancel_rate')} AS cancel_rate, {R('profit_cv', 4)} AS profit_cv,
 dr.v AS dominant_region, dm.v AS dominant_market FROM cm JOIN dr USING (cluster_label) JOIN dm USING (cluster_label) WHERE dr.r = 1 AND dm.r = 1""")
def q_cluster_metrics(spark, sf):
    out = _round(cluster_metrics(spark, sf), 6, "demand_cv", "late_rate", "cancel_rate")
    return _round(_round(out, 4, "profit_mean", "avg_sales", "profit_cv"), 3, "profit_std")


@query("cluster_merge", f"""
WITH {LABELLED}, a AS (SELECT cluster_label, avg(late_risk) AS late_rate FROM lab GROUP BY 1),
b AS (SELECT cluster_label, avg((order_status IN ('CANCELED','ON_HOLD'))::INT) AS cancel_rate FROM lab GROUP BY 1)
SELECT cluster_label, {R('late_rate')} AS late_rate, {R('cancel_rate')} AS cancel_rate FROM a JOIN b USING (cluster_label)""")
def q_cluster_merge(spark, sf):
    """Both summaries come out of one aggregation, so nothing is joined."""
    out = labelled(spark, sf, "late_risk", "order_status").groupBy("cluster_label").agg(
        F.avg("late_risk").alias("late_rate"), F.avg(X.cancel_flag()).alias("cancel_rate"))
    return _round(out, 6, "late_rate", "cancel_rate")


def _norm(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c}-min({c}) OVER ())/(max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END")


@query("resilience_index", f"""
WITH {CM}, n AS (SELECT cluster_label, 1-{_norm('demand_cv')} AS d, 1-{_norm('late_rate')} AS l, 1-{_norm('cancel_rate')} AS o, 1-{_norm('profit_cv')} AS p FROM cm),
x AS (SELECT *, 0.30::DOUBLE*d + 0.35::DOUBLE*l + 0.20::DOUBLE*o + 0.15::DOUBLE*p AS i FROM n)
SELECT cluster_label, {R('d')} AS demand_stability_score, {R('l')} AS delivery_reliability_score, {R('o')} AS order_integrity_score,
 {R('p')} AS profit_consistency_score, {R('i')} AS resilience_index,
 CASE WHEN i <= 0.4 THEN 'Fragile' WHEN i <= 0.6 THEN 'Vulnerable' WHEN i <= 0.8 THEN 'Stable' ELSE 'Resilient' END AS resilience_tier FROM x""")
def q_resilience(spark, sf):
    from cargolens.operators.cluster import resilience_index

    out = resilience_index(cluster_metrics(spark, sf))
    names = ["demand_stability_score", "delivery_reliability_score", "order_integrity_score", "profit_consistency_score", "resilience_index"]
    return _round(out, 6, *names).select("cluster_label", *names, "resilience_tier")
