"""Queries for treatment effects, what-if scenarios and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import causal, classify, explain
from cargolens.plans.inputs import KEYS, items, written
from cargolens.plans.models import (global_forecaster, global_split, labelled, late_classifier, late_levels, late_rows, late_scored, once,
                                     panel_features)
from cargolens.plans.registry import query
from cargolens.plans.sql import PLANAR, R, OI
from cargolens.session import cut

K = "order_id, line_no, product_id, store_id"
CODED = PLANAR + """, cd AS (SELECT *, (shipping_mode IN ('First Class','Same Day'))::INT AS treated, late_risk AS outcome,
 dense_rank() OVER (ORDER BY order_region)-1 AS x1, dense_rank() OVER (ORDER BY market)-1 AS x2, planar_distance_km AS x3,
 dense_rank() OVER (ORDER BY customer_segment)-1 AS x4 FROM pl)"""


def prepared(spark, sf):
    return once(spark, sf, "causal", lambda: cut(causal.causal_prepare(written(
        spark, sf, *KEYS, "shipping_mode", "late_risk", "order_region", "market", "customer_segment", "latitude", "longitude"))))


@query("causal_prepare", f"""
WITH {CODED} SELECT {K}, treated, outcome, x1::INT AS order_region_code, x2::INT AS market_code, {R('x3', 5)} AS planar_distance_km, x4::INT AS customer_segment_code FROM cd""")
def q_prepare(spark, sf):
    out = prepared(spark, sf).select(*KEYS, "treated", "outcome", *causal.LATE_COVARIATES)
    return out.withColumn("planar_distance_km", X.rnd("planar_distance_km", 5))


@query("ate_psm")
def q_psm(spark, sf):
    return causal.ate_psm(prepared(spark, sf))


# Scores by rule, so that matching and weighting have exact oracles.
RULE = OI + """, ru AS (SELECT CAST((order_id*31 + product_id*17 + store_id) % 50021 AS DOUBLE)/50021.0::DOUBLE AS score,
 (shipping_mode IN ('First Class','Same Day'))::INT AS t, late_risk AS y FROM oi),
cl AS (SELECT score, count(*) FILTER (t=1) AS n1, sum(y) FILTER (t=1) AS y1, count(*) FILTER (t=0) AS n0, sum(y) FILTER (t=0) AS y0 FROM ru GROUP BY 1)"""


def rule_cells(spark, sf):
    score = ((F.col("order_id") * 31 + F.col("product_id") * 17 + F.col("store_id")) % 50021).cast("double") / 50021.0
    rows = items(spark, sf, *KEYS, "shipping_mode", "late_risk").select(
        score.alias("score"), F.col("shipping_mode").isin(*X.FAST_MODES).cast("int").alias("treated"), F.col("late_risk").alias("outcome"))
    return causal.cells(rows, ["score"])


MATCH = RULE + """, a1 AS (SELECT score, y1::DOUBLE/n1 AS m FROM cl WHERE n1 > 0), a0 AS (SELECT score, y0::DOUBLE/n0 AS m FROM cl WHERE n0 > 0),
mm AS (SELECT cl.*, l0.score AS ls0, l0.m AS lm0, h0.score AS hs0, h0.m AS hm0, l1.score AS ls1, l1.m AS lm1, h1.score AS hs1, h1.m AS hm1 FROM cl
 ASOF LEFT JOIN a0 l0 ON cl.score >= l0.score ASOF LEFT JOIN a0 h0 ON cl.score <= h0.score
 ASOF LEFT JOIN a1 l1 ON cl.score >= l1.score ASOF LEFT JOIN a1 h1 ON cl.score <= h1.score),
mt AS (SELECT score, n1, coalesce(y1,0) AS y1, n0, coalesce(y0,0) AS y0,
 CASE WHEN hs0 IS NULL THEN lm0 WHEN ls0 IS NULL THEN hm0 WHEN score-ls0 <= hs0-score THEN lm0 ELSE hm0 END AS m0,
 CASE WHEN hs1 IS NULL THEN lm1 WHEN ls1 IS NULL THEN hm1 WHEN score-ls1 <= hs1-score THEN lm1 ELSE hm1 END AS m1 FROM mm)"""


@query("nearest_score_match", f"WITH {MATCH} SELECT {R('score', 8)} AS score, n1, n0, {R('m0')} AS m0, {R('m1')} AS m1 FROM mt")
def q_match(spark, sf):
    out = causal.nearest_score_match(rule_cells(spark, sf))
    return out.select(X.rnd("score", 8).alias("score"), "n1", "n0", X.rnd("m0", 6).alias("m0"), X.rnd("m1", 6).alias("m1"))


@query("match_ate", f"WITH {MATCH} SELECT {R('sum((y1-n1*m0)+(n0*m1-y0))/sum(n1+n0)')} AS ate, sum(n1+n0)::BIGINT AS n FROM mt")
def q_match_ate(spark, sf):
    return causal.match_ate(causal.nearest_score_match(rule_cells(spark, sf))).withColumn("ate", X.rnd("ate", 6))


@query("ate_ipw", f"""
WITH {RULE} SELECT {R('(sum(t*y/least(greatest(score,0.05),0.95)) - sum((1-t)*y/(1-least(greatest(score,0.05),0.95))))/count(*)')} AS ate, count(*) AS n FROM ru""")
def q_ipw(spark, sf):
    return causal.ate_ipw(rule_cells(spark, sf)).withColumn("ate", X.rnd("ate", 6))


@query("ate_linear", f"""
WITH {CODED}, c0 AS (SELECT treated - avg(treated) OVER () AS t, outcome - avg(outcome) OVER () AS y, x1 - avg(x1) OVER () AS a, x2 - avg(x2) OVER () AS b,
 x3 - avg(x3) OVER () AS c, x4 - avg(x4) OVER () AS d FROM cd),
c1 AS (SELECT *, b - a*(sum(a*b) OVER ())/(sum(a*a) OVER ()) AS b1 FROM c0),
c2 AS (SELECT *, c - a*(sum(a*c) OVER ())/(sum(a*a) OVER ()) - b1*(sum(b1*c) OVER ())/(sum(b1*b1) OVER ()) AS c1 FROM c1),
c3 AS (SELECT *, d - a*(sum(a*d) OVER ())/(sum(a*a) OVER ()) - b1*(sum(b1*d) OVER ())/(sum(b1*b1) OVER ()) - c1*(sum(c1*d) OVER ())/(sum(c1*c1) OVER ()) AS d1 FROM c2),
c4 AS (SELECT *, t - a*(sum(a*t) OVER ())/(sum(a*a) OVER ()) - b1*(sum(b1*t) OVER ())/(sum(b1*b1) OVER ()) - c1*(sum(c1*t) OVER ())/(sum(c1*c1) OVER ())
 - d1*(sum(d1*t) OVER ())/(sum(d1*d1) OVER ()) AS t1 FROM c3)
SELECT {R('sum(t1*y)/sum(t1*t1)')} AS ate, count(*) AS n FROM c4""")
def q_linear(spark, sf):
    return causal.ate_linear(prepared(spark, sf)).select(X.rnd("ate", 6).alias("ate"), "n")


@query("ate_linear_interval")
def q_linear_interval(spark, sf):
    return causal.ate_linear(prepared(spark, sf))


@query("refute_placebo")
def q_placebo(spark, sf):
    return causal.refute_placebo(prepared(spark, sf))


@query("refute_random_cause")
def q_random(spark, sf):
    return causal.refute_random_cause(prepared(spark, sf))


@query("fraud_ate")
def q_fraud(spark, sf):
    """Discounts of the given tables end at 0.10, so the operator's default of 0.20 would leave no treated order: half of that range counts as high here."""
    df = items(spark, sf, "order_region", "customer_segment", "discount_rate", "order_status")
    return causal.ate_psm(causal.fraud_prepare(df, 0.05), causal.FRAUD_COVARIATES)


@query("ate_ci")
def q_ci(spark, sf):
    return causal.ate_ci(prepared(spark, sf), replicates=100)


@query("whatif_cost", f"""
WITH {OI} SELECT count(*) AS orders_affected, sum(5 - CASE shipping_mode WHEN 'Same Day' THEN 12 WHEN 'First Class' THEN 5 WHEN 'Second Class' THEN 2 ELSE 0 END)::DOUBLE AS shipping_cost_delta,
 {R('sum(profit)', 2)} AS baseline_profit FROM oi WHERE market = 'ASIA' AND sales > 200""")
def q_whatif_cost(spark, sf):
    out = causal.whatif_cost(items(spark, sf, "market", "sales", "shipping_mode", "profit"), "market = 'ASIA' and sales > 200", "First Class")
    return out.withColumn("baseline_profit", X.rnd("baseline_profit", 2))


SCENARIOS = [
    ("ASIA above 200 by First Class", "market = 'ASIA' and sales > 200", {"shipping_mode": "First Class"}),
    ("NATION_5 by Same Day", "order_region = 'NATION_5'", {"shipping_mode": "Same Day"}),
    ("No discounts for BUILDING", "customer_segment = 'BUILDING'", {"discount_rate": 0.0}),
    ("Nobody", "customer_segment = 'none'", {"discount_rate": 0.0}),
]


@query("whatif_scenario")
def q_whatif(spark, sf):
    rows = causal.scenario_rows(labelled(spark, sf), *SCENARIOS[0], late_classifier(spark, sf), late_levels(spark, sf))
    return causal.scenario_summary(rows)


@query("whatif_compare")
def q_compare(spark, sf):
    return causal.whatif_compare(labelled(spark, sf), SCENARIOS, late_classifier(spark, sf), late_levels(spark, sf))


# --- Explanations ------------------------------------------------------------------------


def shapley(spark, sf):
    def build():
        rows, names = late_rows(spark, sf)
        return cut(explain.shapley_sample(late_classifier(spark, sf), rows, names, [*KEYS, "macro_region"]))

    return once(spark, sf, "shapley", build)


@query("shapley_sample")
def q_shapley(spark, sf):
    return shapley(spark, sf)


@query("shapley_demand")
def q_shapley_demand(spark, sf):
    """The demand model explained on its test rows."""
    rows = global_split(spark, sf).where("is_train = 0").withColumn("day", F.col("date").cast("string"))
    return explain.shapley_sample(global_forecaster(spark, sf), rows, panel_features(rows), ["macro_region", "day"])


@query("global_attribution_model")
def q_global_attribution_model(spark, sf):
    return explain.global_attribution(shapley(spark, sf))


PHI = OI + """, ph AS (SELECT order_region AS macro_region, f AS feature, CASE f WHEN 'quantity' THEN (quantity-25)/50 WHEN 'discount' THEN discount_rate-0.05
 WHEN 'days' THEN (days_real-3)/7.0::DOUBLE ELSE (late_risk-0.5::DOUBLE) END AS phi FROM oi, (VALUES ('quantity'),('discount'),('days'),('late')) v(f))"""


def rule_phi(spark, sf):
    c = F.col
    parts = {"quantity": (c("quantity") - 25) / 50, "discount": c("discount_rate") - 0.05, "days": (c("days_real") - 3) / 7.0, "late": c("late_risk") - 0.5}
    return items(spark, sf, "order_region", "quantity", "discount_rate", "days_real", "late_risk").select(
        c("order_region").alias("macro_region"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("phi")) for k, v in parts.items()])))


@query("global_attribution", f"WITH {PHI} SELECT feature, {R('avg(abs(phi))')} AS mean_abs_phi FROM ph GROUP BY 1")
def q_global_attribution(spark, sf):
    return explain.global_attribution(rule_phi(spark, sf)).withColumn("mean_abs_phi", X.rnd("mean_abs_phi", 6))


@query("regional_shap_agg", f"""
WITH {PHI}, b AS (SELECT feature FROM ph GROUP BY 1 ORDER BY avg(abs(phi)) DESC, 1 LIMIT 3)
SELECT macro_region, feature, {R('abs(avg(phi))')} AS abs_mean_phi FROM ph JOIN b USING (feature) GROUP BY 1, 2""")
def q_regional_attribution(spark, sf):
    return explain.regional_attribution(rule_phi(spark, sf), top=3).withColumn("abs_mean_phi", X.rnd("abs_mean_phi", 6))


@query("local_surrogate")
def q_surrogate(spark, sf):
    """The riskiest 20 orders (a top-k report) explained one by one."""
    rows, names = late_rows(spark, sf)
    best = late_scored(spark, sf).orderBy(F.desc("score"), *KEYS).limit(20).select(*KEYS)
    chosen = rows.join(F.broadcast(best), list(KEYS), "left_semi")
    return explain.local_surrogate(late_classifier(spark, sf), rows, chosen, names, KEYS)


@query("batch_explain")
def q_batch(spark, sf):
    """Every order with a late probability of 0.7 or more, explained from the default number of copies each; the 20 riskiest listed."""
    rows, names = late_rows(spark, sf)
    scored = rows.join(late_scored(spark, sf).select(*KEYS, "score"), list(KEYS))
    explained = explain.batch_explain(late_classifier(spark, sf), rows, scored, names, KEYS)
    return explain.riskiest(explained, KEYS)
