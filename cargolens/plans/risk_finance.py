"""Queries for composite risk, costs, Pareto fronts and carbon-adjusted profit."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import finance, risk
from cargolens.plans.inputs import KEYS, items, scored_items, written
from cargolens.plans.registry import query
from cargolens.plans.sql import OI, PLANAR, R, SCORED

K = "order_id, line_no, product_id, store_id"
COMP = SCORED + """, cr AS (SELECT *, 0.45::DOUBLE*p_late + 0.35::DOUBLE*p_fraud + 0.20::DOUBLE*p_cancel AS s FROM sc),
rk AS (SELECT *, CASE WHEN s <= 0.3 THEN 'Low' WHEN s <= 0.5 THEN 'Medium' WHEN s <= 0.7 THEN 'High' ELSE 'Critical' END AS risk_tier, (s >= 0.7)::INT AS requires_review FROM cr)"""


def _round(df, places, *names):
    return df.withColumns({n: X.rnd(n, places) for n in names})


def composite(spark, sf):
    return risk.composite_risk(scored_items(spark, sf, "order_region", "market"))


@query("composite_risk", f"""
WITH {COMP} SELECT {K}, order_region, market, round_even(p_late, 4) AS p_late, round_even(p_fraud, 4) AS p_fraud, round_even(p_cancel, 4) AS p_cancel,
 round_even(s, 4) AS composite_risk_score, risk_tier, requires_review FROM rk""")
def q_composite(spark, sf):
    return composite(spark, sf).select(*KEYS, "order_region", "market", "p_late", "p_fraud", "p_cancel", "composite_risk_score", "risk_tier", "requires_review")


@query("flagged_orders", f"WITH {COMP} SELECT {K}, round_even(s, 4) AS composite_risk_score, risk_tier FROM rk WHERE requires_review = 1")
def q_flagged(spark, sf):
    return risk.flagged_orders(composite(spark, sf)).select(*KEYS, "composite_risk_score", "risk_tier")


@query("risk_tier_pivot", f"""
WITH {COMP} SELECT order_region, """ + ", ".join(f"count(*) FILTER (risk_tier='{t}') AS \"{t}\"" for t in X.RISK_TIERS[1]) + " FROM rk GROUP BY 1")
def q_pivot(spark, sf):
    return risk.risk_tier_pivot(composite(spark, sf))


@query("risk_histogram", f"""
WITH {COMP}, i AS (SELECT round_even(s, 4)*100 AS v FROM rk), m AS (SELECT min(v) AS lo, max(v) AS hi FROM i)
SELECT least(greatest(floor((v-lo)/(hi-lo)*40)::INT, 0), 39)::INT AS bin, count(*) AS count, {R('min(v)', 4)} AS smallest, {R('max(v)', 4)} AS largest FROM i, m GROUP BY 1""")
def q_risk_hist(spark, sf):
    return _round(risk.risk_histogram(composite(spark, sf)), 4, "smallest", "largest")


# --- Costs -------------------------------------------------------------------------------

COST_FN = 43.5


@query("fn_fp_costs", f"WITH {OI} SELECT {R('avg(greatest(benefit, 0))', 4)} AS cost_fn, 5.0::DOUBLE AS cost_fp FROM oi")
def q_costs(spark, sf):
    return _round(finance.fn_fp_costs(items(spark, sf, "benefit")), 4, "cost_fn")


def labelled_scores(spark, sf):
    return scored_items(spark, sf).select("*", F.col("p_late").alias("score"), F.col("late_risk").alias("label"),
                                          (F.col("p_late") >= 0.5).cast("int").alias("predicted"))


@query("total_cost", f"""
WITH {SCORED}, t AS (SELECT count(*) FILTER (late_risk=1 AND p_late < 0.5) AS fn, count(*) FILTER (late_risk=0 AND p_late >= 0.5) AS fp FROM sc)
SELECT fn, fp, {R(f'fn*{COST_FN} + fp*5.0', 2)} AS total_cost FROM t""")
def q_total_cost(spark, sf):
    return _round(finance.total_cost(labelled_scores(spark, sf), COST_FN), 2, "total_cost")


CURVE = SCORED + f""", th AS (SELECT (i/100.0::DOUBLE) AS threshold FROM range(10, 91) t(i)),
cc AS (SELECT threshold, count(*) FILTER (late_risk=1 AND p_late < threshold) AS fn, count(*) FILTER (late_risk=0 AND p_late >= threshold) AS fp FROM th, sc GROUP BY 1),
cv AS (SELECT *, fn*{COST_FN} + fp*5.0 AS c FROM cc)"""


@query("cost_curve", f"WITH {CURVE} SELECT threshold, fn, fp, {R('c', 2)} AS total_cost FROM cv")
def q_cost_curve(spark, sf):
    return _round(finance.cost_curve(labelled_scores(spark, sf), COST_FN), 2, "total_cost")


@query("cost_threshold", f"""
WITH {CURVE}, b AS (SELECT threshold, c FROM cv ORDER BY c, threshold LIMIT 1), d AS (SELECT c AS dc FROM cv WHERE threshold = 0.5)
SELECT threshold AS optimal_threshold, {R('c', 2)} AS optimal_cost, {R('dc', 2)} AS default_cost, {R('dc-c', 2)} AS savings, {R('(dc-c)/dc*100', 4)} AS savings_pct FROM b, d""")
def q_cost_threshold(spark, sf):
    out = finance.cost_threshold(labelled_scores(spark, sf), COST_FN)
    return _round(_round(out, 2, "optimal_cost", "default_cost", "savings"), 4, "savings_pct")


# --- Trade-offs --------------------------------------------------------------------------

TRADE = OI + """, tr AS (SELECT market, shipping_mode, avg(late_risk) AS late_rate, avg(profit) AS avg_profit, count(*) AS order_count,
 (CASE shipping_mode WHEN 'Same Day' THEN 18 WHEN 'First Class' THEN 7.5 WHEN 'Second Class' THEN 2.5 ELSE 0 END)::DOUBLE AS cost_proxy FROM oi GROUP BY 1, 2),
pf AS (SELECT *, (NOT EXISTS (SELECT 1 FROM tr b WHERE b.market = a.market AND b.late_rate <= a.late_rate AND b.cost_proxy <= a.cost_proxy
 AND (b.late_rate < a.late_rate OR b.cost_proxy < a.cost_proxy)))::INT AS is_pareto FROM tr a)"""


def tradeoff(spark, sf):
    return finance.mode_tradeoff(items(spark, sf, "market", "shipping_mode", "late_risk", "profit"))


@query("mode_tradeoff", f"WITH {TRADE} SELECT market, shipping_mode, {R('late_rate')} AS late_rate, {R('avg_profit', 4)} AS avg_profit, order_count, cost_proxy FROM tr")
def q_tradeoff(spark, sf):
    return _round(_round(tradeoff(spark, sf), 6, "late_rate"), 4, "avg_profit")


@query("pareto_front", f"WITH {TRADE} SELECT market, shipping_mode, {R('late_rate')} AS late_rate, cost_proxy, is_pareto FROM pf")
def q_pareto(spark, sf):
    return _round(finance.pareto_front(tradeoff(spark, sf)), 6, "late_rate").select("market", "shipping_mode", "late_rate", "cost_proxy", "is_pareto")


# A wide option table for the dominance test: products by mean price and late rate.
OPT = OI + """, op AS (SELECT market, product_id, avg(sales) AS cost_proxy, avg(late_risk) AS late_rate FROM oi GROUP BY 1, 2)"""


@query("dominance_anti_join", f"""
WITH {OPT} SELECT market, product_id, {R('cost_proxy', 3)} AS cost_proxy, {R('late_rate')} AS late_rate FROM op a WHERE NOT EXISTS (SELECT 1 FROM op b
 WHERE b.market = a.market AND b.late_rate <= a.late_rate AND b.cost_proxy <= a.cost_proxy AND (b.late_rate < a.late_rate OR b.cost_proxy < a.cost_proxy))""")
def q_dominance(spark, sf):
    options = items(spark, sf, "market", "product_id", "sales", "late_risk").groupBy("market", "product_id").agg(
        F.avg("sales").alias("cost_proxy"), F.avg("late_risk").alias("late_rate"))
    front = finance.pareto_front(options).where("is_pareto = 1").drop("is_pareto")
    return _round(_round(front, 3, "cost_proxy"), 6, "late_rate").select("market", "product_id", "cost_proxy", "late_rate")


# --- Carbon ------------------------------------------------------------------------------

ESG = PLANAR + """, es AS (SELECT *, planar_distance_km*0.20::DOUBLE*(CASE shipping_mode WHEN 'Same Day' THEN 3.5 WHEN 'First Class' THEN 2.0 WHEN 'Second Class' THEN 1.2 ELSE 1.0 END)::DOUBLE*quantity AS carbon_kg FROM pl),
ec AS (SELECT *, carbon_kg*0.05::DOUBLE AS esg_cost, profit/greatest(carbon_kg, 0.01::DOUBLE) AS ppc FROM es)"""


def esg(spark, sf):
    return finance.esg_score(written(spark, sf, *KEYS, "latitude", "longitude", "market", "order_region", "shipping_mode", "quantity", "profit"))


@query("esg_score", f"""
WITH {ESG} SELECT {K}, {R('carbon_kg', 3)} AS carbon_kg, {R('esg_cost', 3)} AS esg_cost, {R('profit - esg_cost', 3)} AS esg_adjusted_profit, {R('ppc', 3)} AS profit_per_carbon_kg FROM ec""")
def q_esg(spark, sf):
    names = ["carbon_kg", "esg_cost", "esg_adjusted_profit", "profit_per_carbon_kg"]
    return _round(esg(spark, sf).select(*KEYS, *names), 3, *names)


@query("esg_summary", f"""
WITH {ESG} SELECT market, {R('sum(profit)', 2)} AS total_profit, {R('sum(esg_cost)', 2)} AS total_esg_cost, {R('sum(profit - esg_cost)', 2)} AS total_esg_adjusted_profit,
 {R('avg(carbon_kg)', 3)} AS avg_carbon, {R('avg(ppc)', 4)} AS avg_profit_per_carbon, count(order_id) AS order_count,
 round_even(sum(esg_cost)/sum(profit)*100, 2) AS esg_cost_pct FROM ec GROUP BY 1""")
def q_esg_summary(spark, sf):
    out = finance.esg_summary(esg(spark, sf))
    out = _round(out, 2, "total_profit", "total_esg_cost", "total_esg_adjusted_profit")
    return _round(_round(out, 3, "avg_carbon"), 4, "avg_profit_per_carbon")
