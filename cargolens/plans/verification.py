"""Queries for model verification given scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import panel, verify
from cargolens.plans.inputs import KEYS, items, regional, rule_scores
from cargolens.plans.registry import query
from cargolens.plans.risk_finance import labelled_scores
from cargolens.plans.sql import PANEL, R, SCORED
from cargolens.plans.tests_stat import RES, residual_rows


def _round(df, places, *names):
    return df.withColumns({n: X.rnd(n, places) for n in names})


def reg_sql(y: str, p: str, e: str) -> str:
    """Regression metrics of columns y and prediction in SQL."""
    return (f"count(*) AS n, {R(f'avg(abs({e}))', 4)} AS mae, {R(f'sqrt(avg(({e})*({e})))', 4)} AS rmse, "
            f"{R(f'1 - sum(({e})*({e}))/(var_pop({y})*count(*))')} AS r2, {R(f'avg(abs(({e})/{y})) FILTER (abs({y}) > 1e-8)*100', 4)} AS mape")


@query("regression_metrics", f"WITH {RES} SELECT {reg_sql('y', 'prediction', 'y - prediction')} FROM rs")
def q_regression(spark, sf):
    return _round(_round(verify.regression_metrics(residual_rows(spark, sf)), 4, "mae", "rmse", "mape"), 6, "r2")


CF = SCORED + """, cf AS (SELECT count(*) FILTER (late_risk=0 AND p_late < 0.5) AS tn, count(*) FILTER (late_risk=0 AND p_late >= 0.5) AS fp,
 count(*) FILTER (late_risk=1 AND p_late < 0.5) AS fn, count(*) FILTER (late_risk=1 AND p_late >= 0.5) AS tp FROM sc)"""


@query("confusion_prf", f"WITH {CF} SELECT tn, fp, fn, tp, {R('tp/(tp+fp)')} AS precision, {R('tp/(tp+fn)')} AS recall, {R('2*tp/(2*tp+fp+fn)')} AS f1 FROM cf")
def q_confusion(spark, sf):
    return _round(verify.confusion(labelled_scores(spark, sf)), 6, "precision", "recall", "f1")


@query("class_report", f"""
WITH {CF} SELECT 0 AS class, {R('tn/(tn+fn)')} AS precision, {R('tn/(tn+fp)')} AS recall, {R('2*tn/(2*tn+fp+fn)')} AS f1, tn+fp AS support FROM cf
UNION ALL SELECT 1 AS class, {R('tp/(tp+fp)')} AS precision, {R('tp/(tp+fn)')} AS recall, {R('2*tp/(2*tp+fp+fn)')} AS f1, tp+fn AS support FROM cf""")
def q_report(spark, sf):
    return _round(verify.class_report(labelled_scores(spark, sf)), 6, "precision", "recall", "f1")


CURVES = SCORED + """, sv AS (SELECT p_late AS threshold, count(*) FILTER (late_risk=1) AS pos, count(*) FILTER (late_risk=0) AS neg FROM sc GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM sv)"""


@query("roc_curve", f"WITH {CURVES} SELECT {R('threshold', 8)} AS threshold, {R('fp/an')} AS fpr, {R('tp/ap')} AS tpr FROM cu")
def q_roc(spark, sf):
    return _round(_round(verify.roc_curve(labelled_scores(spark, sf)), 6, "fpr", "tpr"), 8, "threshold")


@query("auc", f"""
WITH {SCORED}, r AS (SELECT late_risk, rank() OVER (ORDER BY p_late) + (count(*) OVER (PARTITION BY p_late) - 1)/2.0::DOUBLE AS rk FROM sc)
SELECT {R('(sum(rk) FILTER (late_risk=1) - count(*) FILTER (late_risk=1)*(count(*) FILTER (late_risk=1)+1)/2.0)/(count(*) FILTER (late_risk=1)*count(*) FILTER (late_risk=0))')} AS auc FROM r""")
def q_auc(spark, sf):
    return _round(verify.ranking_scores(labelled_scores(spark, sf)), 6, "auc").select("auc")


@query("pr_curve", f"WITH {CURVES} SELECT {R('threshold', 8)} AS threshold, {R('tp/(tp+fp)')} AS precision, {R('tp/ap')} AS recall FROM cu")
def q_pr(spark, sf):
    return _round(_round(verify.pr_curve(labelled_scores(spark, sf)), 6, "precision", "recall"), 8, "threshold")


@query("avg_precision", f"WITH {CURVES} SELECT {R('sum(pos*tp/(tp+fp))/any_value(ap)')} AS avg_precision FROM cu")
def q_ap(spark, sf):
    return _round(verify.ranking_scores(labelled_scores(spark, sf)), 6, "avg_precision").select("avg_precision")


@query("best_f1_threshold", f"""
WITH {CURVES}, f AS (SELECT threshold, tp/(tp+fp) AS p, tp/ap AS r, 2*(tp/(tp+fp))*(tp/ap)/((tp/(tp+fp))+(tp/ap)+1e-8) AS f1 FROM cu)
SELECT {R('threshold', 8)} AS threshold, {R('f1')} AS f1, {R('p')} AS precision, {R('r')} AS recall FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""")
def q_best_f1(spark, sf):
    return _round(_round(verify.best_f1_threshold(labelled_scores(spark, sf)), 6, "f1", "precision", "recall"), 8, "threshold")


CAL = SCORED + """, cb AS (SELECT least(floor(p_late*10)::INT, 9)::INT AS bin, avg(late_risk) AS observed, avg(p_late) AS predicted, count(*) AS count FROM sc GROUP BY 1)"""


@query("calibration", f"WITH {CAL} SELECT bin, {R('observed')} AS observed, {R('predicted')} AS predicted, count FROM cb")
def q_calibration(spark, sf):
    return _round(verify.calibration(labelled_scores(spark, sf)), 6, "observed", "predicted")


@query("calibration_error", f"WITH {CAL} SELECT {R('avg(abs(observed - predicted))')} AS calibration_error FROM cb")
def q_calibration_error(spark, sf):
    return _round(verify.calibration_error(verify.calibration(labelled_scores(spark, sf))), 6, "calibration_error")


@query("score_distribution", f"WITH {SCORED} SELECT late_risk AS label, least(floor(p_late*50)::INT, 49)::INT AS bin, count(*) AS count FROM sc GROUP BY 1, 2")
def q_distribution(spark, sf):
    return verify.score_distribution(labelled_scores(spark, sf))


# Naive forecasts on the panel, by rule: monthly mean as the global model, weekly lag as the regional one.
PREDS = PANEL + """, pp AS (SELECT macro_region, date, sales AS y, avg(sales) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS global_prediction,
 CASE WHEN length(macro_region) = 8 THEN NULL ELSE lag(sales, 7) OVER w END AS regional_prediction FROM panel WINDOW w AS (PARTITION BY macro_region ORDER BY date)),
pe AS (SELECT *, CASE WHEN regional_prediction IS NULL THEN global_prediction ELSE 0.7::DOUBLE*regional_prediction + 0.3::DOUBLE*global_prediction END AS prediction FROM pp)"""


def naive_forecasts(spark, sf):
    daily = panel.regional_daily_panel(regional(spark, sf, "order_date", "sales", "quantity", "late_risk", "customer_id"))
    p = panel.add_rolls(panel.add_lags(daily, (7,), ("sales",)), (30,))
    return p.select("macro_region", "date", F.col("sales").alias("y"), F.col("sales_roll_30").alias("global_prediction"),
                    F.when(F.length("macro_region") != 8, F.col("sales_lag_7")).alias("regional_prediction"))


@query("ensemble_forecast", f"WITH {PREDS} SELECT macro_region, date::VARCHAR AS date, {R('y', 2)} AS y, {R('prediction', 3)} AS prediction FROM pe")
def q_ensemble(spark, sf):
    from cargolens.operators.forecast import ensemble_forecast

    out = ensemble_forecast(naive_forecasts(spark, sf))
    return out.select("macro_region", F.col("date").cast("string").alias("date"), X.rnd("y", 2).alias("y"), X.rnd("prediction", 3).alias("prediction"))


@query("model_comparison", f"""
WITH {PREDS}, g AS (SELECT avg(abs(y-global_prediction)) AS mae, sqrt(avg((y-global_prediction)^2)) AS rmse, 1-sum((y-global_prediction)^2)/(var_pop(y)*count(*)) AS r2 FROM pe),
rr AS (SELECT macro_region, avg(abs(y-regional_prediction)) AS mae, sqrt(avg((y-regional_prediction)^2)) AS rmse,
 1-sum((y-regional_prediction)^2)/(var_pop(y)*count(*)) AS r2 FROM pe WHERE regional_prediction IS NOT NULL GROUP BY 1),
r AS (SELECT avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM rr),
e AS (SELECT avg(abs(y-prediction)) AS mae, sqrt(avg((y-prediction)^2)) AS rmse, 1-sum((y-prediction)^2)/(var_pop(y)*count(*)) AS r2 FROM pe),
u AS (SELECT 'Global' AS model, * FROM g UNION ALL SELECT 'Regional (Avg)', * FROM r UNION ALL SELECT 'Ensemble', * FROM e)
SELECT model, {R('u.mae', 3)} AS mae, {R('u.rmse', 3)} AS rmse, {R('u.r2')} AS r2, {R('(g.mae - u.mae)/g.mae*100', 4)} AS mae_gain_pct FROM u, g""")
def q_comparison(spark, sf):
    from cargolens.operators.forecast import ensemble_forecast, model_comparison

    p = ensemble_forecast(naive_forecasts(spark, sf))
    perf = verify.regression_metrics(p.where("regional_prediction is not null"), predicted="regional_prediction", by=["macro_region"])
    out = model_comparison(verify.regression_metrics(p, predicted="global_prediction"), perf, verify.regression_metrics(p))
    return _round(_round(_round(out, 3, "mae", "rmse"), 6, "r2"), 4, "mae_gain_pct")


@query("ridge_stack", f"""
WITH {PREDS}, b AS (SELECT y, global_prediction AS a, regional_prediction AS b FROM pp WHERE regional_prediction IS NOT NULL),
s AS (SELECT var_pop(a)*count(*)+1 AS aa, var_pop(b)*count(*)+1 AS bb, covar_pop(a,b)*count(*) AS ab, covar_pop(a,y)*count(*) AS ay, covar_pop(b,y)*count(*) AS byy,
 avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM b),
w AS (SELECT (ay*bb-byy*ab)/(aa*bb-ab*ab) AS w1, (byy*aa-ay*ab)/(aa*bb-ab*ab) AS w2, ma, mb, my FROM s)
SELECT {R('w1', 7)} AS weight_a, {R('w2', 7)} AS weight_b, {R('my - w1*ma - w2*mb', 2)} AS intercept FROM w""")
def q_ridge(spark, sf):
    from cargolens.operators.forecast import ridge_weights

    p = naive_forecasts(spark, sf).where("regional_prediction is not null")
    out = ridge_weights(p, "global_prediction", "regional_prediction", "y")
    return _round(_round(out, 7, "weight_a", "weight_b"), 2, "intercept")


@query("stack_comparison")
def q_stack(spark, sf):
    from cargolens.operators.forecast import stack_comparison

    p = naive_forecasts(spark, sf).where("regional_prediction is not null")
    return stack_comparison(p, "global_prediction", "regional_prediction", "y")



@query("overfit_check", f"""
WITH {SCORED}, t AS (SELECT CASE WHEN order_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, sales AS y, 0.8::DOUBLE*sales + (CASE WHEN order_id % 10 < 7 THEN 10000.0 ELSE 30000.0 END)::DOUBLE*h AS p FROM sc),
m AS (SELECT split, avg(abs(y-p)) AS mae, 1-sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2 FROM t GROUP BY 1)
SELECT {R("max(mae) FILTER (split='train')", 3)} AS train_mae, {R("max(mae) FILTER (split='test')", 3)} AS test_mae, {R("max(r2) FILTER (split='train')")} AS train_r2,
 {R("max(r2) FILTER (split='test')")} AS test_r2, {R("max(r2) FILTER (split='train') - max(r2) FILTER (split='test')")} AS gap,
 CASE WHEN max(r2) FILTER (split='train') - max(r2) FILTER (split='test') > 0.15 THEN 'OVERFITTING'
 WHEN max(r2) FILTER (split='train') - max(r2) FILTER (split='test') < 0.02 THEN 'OK' ELSE 'MILD' END AS verdict FROM m""")
def q_overfit(spark, sf):
    df = rule_scores(items(spark, sf, *KEYS, "late_risk", "sales"))
    train = F.col("order_id") % 10 < 7
    rows = df.select(F.when(train, "train").otherwise("test").alias("split"), F.col("sales").alias("y"),
                     (0.8 * F.col("sales") + F.when(train, 10000.0).otherwise(30000.0) * F.col("h")).alias("prediction"))
    out = verify.overfit_check(verify.regression_metrics(rows, by=["split"]))
    return _round(_round(out, 3, "train_mae", "test_mae"), 6, "train_r2", "test_r2", "gap").select(
        "train_mae", "test_mae", "train_r2", "test_r2", "gap", "verdict")


@query("efficiency_verdict", f"""
WITH {CF}, rs AS (SELECT sales AS y, 0.8::DOUBLE*sales + 10000.0::DOUBLE*h AS p, order_id % 5 AS fold FROM sc),
r AS (SELECT 1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2 FROM rs), fr AS (SELECT fold, 1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2 FROM rs GROUP BY 1),
v AS (SELECT r2, 2*tp/(2*tp+fp+fn) AS f1, (SELECT stddev_samp(r2) FROM fr) AS sd FROM cf, r)
SELECT 'forecast' AS part, {R('r2')} AS value, CASE WHEN r2 > 0.8 THEN 'STRONG' WHEN r2 > 0.6 THEN 'MODERATE' ELSE 'NEEDS IMPROVEMENT' END AS verdict FROM v
UNION ALL SELECT 'classifier', {R('f1')}, CASE WHEN f1 > 0.9 THEN 'STRONG' WHEN f1 > 0.75 THEN 'MODERATE' ELSE 'NEEDS IMPROVEMENT' END FROM v
UNION ALL SELECT 'forecast_cv', {R('sd')}, CASE WHEN sd < 0.05 THEN 'STABLE' ELSE 'VARIABLE' END FROM v""")
def q_verdict(spark, sf):
    df = rule_scores(items(spark, sf, *KEYS, "late_risk", "sales"))
    rows = df.select(F.col("sales").alias("y"), (0.8 * F.col("sales") + 10000.0 * F.col("h")).alias("prediction"),
                     (F.col("order_id") % 5).alias("fold"))
    per_fold = verify.regression_metrics(rows, by=["fold"]).agg(F.stddev_samp("r2")).scalar()
    r2 = verify.regression_metrics(rows).select("r2").scalar()
    base = verify.confusion(labelled_scores(spark, sf)).select(F.col("f1"), r2.alias("r2"), per_fold.alias("cv_std"))
    return _round(verify.efficiency_verdict("r2", "f1", "cv_std", base), 6, "value")


@query("panel_metrics_by_region", f"WITH {PREDS} SELECT macro_region, {reg_sql('y', 'global_prediction', 'y - global_prediction')} FROM pe GROUP BY 1")
def q_metrics_region(spark, sf):
    out = verify.regression_metrics(naive_forecasts(spark, sf), predicted="global_prediction", by=["macro_region"])
    return _round(_round(out, 4, "mae", "rmse", "mape"), 6, "r2")
