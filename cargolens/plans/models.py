"""Queries that fit and apply models.

Each model is fitted once per session and folder and shared by the queries that need it. The
registered queries fit the full sizes on all rows, which are the operators' defaults.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cargolens.operators import classify, cluster, features, forecast, panel, risk, scoring, verify
from cargolens.operators.scale import row_index
from cargolens.operators.trees import Plan
from cargolens.plans.inputs import FEATURE_INPUTS, KEYS, feature_items, feature_table, items
from cargolens.plans.registry import query
from cargolens.plans.sql import OI, PANEL
from cargolens.session import cut, shared_dir
from cargolens.sources.models import load_bundle, save_bundle

# Ensembles of the learning curves, as published.
CURVE_BOOSTED, CURVE_FOREST = 100, 50

_shared: dict = {}


def once(spark, folder, name, build):
    """Result of ``build`` kept for this session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def forget():
    """Drop everything that queries share."""
    _shared.clear()


def table(spark, sf):
    # The rows behind it are written; what is added to them is cheap, so the table itself is not written again.
    return once(spark, sf, "features", lambda: feature_table(spark, sf))


# --- Clusters ----------------------------------------------------------------------------


def scaled(spark, sf):
    """Scaled cluster features, written once."""
    def build():
        out, names = cluster.cluster_features(table(spark, sf))
        return cut(out.select(*KEYS, "macro_region", *cluster.CLUSTER_FEATURES, *names)), names

    return once(spark, sf, "cluster_rows", build)


def scaled_numbered(spark, sf):
    """The same with a row number as ``id``, which takes a sort of all rows that K-Means does without."""
    rows, names = scaled(spark, sf)
    return once(spark, sf, "cluster_rows_numbered", lambda: cut(row_index(rows, alias="id").drop("id_size"))), names


def sweep(spark, sf):
    rows, names = scaled(spark, sf)
    return once(spark, sf, "kmeans", lambda: cluster.kmeans_sweep(cluster.with_vector(rows, names)))


def best_centres(spark, sf):
    found, models = sweep(spark, sf)
    return models[found.where("is_best = 1").first()["k"]]


def labeller(spark, sf):
    return once(spark, sf, "labeller", lambda: cluster.Labeller.of(table(spark, sf), best_centres(spark, sf)))


def labelled(spark, sf):
    """The feature table with every order line's cluster."""
    return once(spark, sf, "labelled", lambda: cut(labeller(spark, sf).label(table(spark, sf))))


# --- Forecasting -------------------------------------------------------------------------


def panel_rows(spark, sf):
    def build():
        ft = labelled(spark, sf)
        p = panel.build_panel(ft, features.regional_stats(ft), panel.dominant_cluster(ft))
        return cut(panel.model_rows(p))

    return once(spark, sf, "panel", build)


def panel_features(rows):
    return [c for c in panel.FORECAST_FEATURES if c in rows.columns]


def global_split(spark, sf):
    return once(spark, sf, "global_split", lambda: cut(panel.temporal_split(panel_rows(spark, sf))))


def region_split(spark, sf):
    return once(spark, sf, "region_split", lambda: cut(panel.regional_split(panel_rows(spark, sf)), by=panel.REGION))


def global_forecaster(spark, sf):
    rows = global_split(spark, sf)
    return once(spark, sf, "global_forecaster", lambda: forecast.fit_global(rows, panel_features(rows)))


def regional_forecasters(spark, sf):
    rows = region_split(spark, sf)
    return once(spark, sf, "regional_forecasters",
                lambda: forecast.fit_regional(rows, panel_features(rows)))


def scored_test(spark, sf):
    return once(spark, sf, "ensemble_test", lambda: cut(
        forecast.evaluate_ensemble(global_forecaster(spark, sf), regional_forecasters(spark, sf), global_split(spark, sf))))


@query("global_forecaster")
def q_global(spark, sf):
    rows = forecast.predict(global_forecaster(spark, sf), global_split(spark, sf).where("is_train = 0"))
    return verify.regression_metrics(rows, "sales")


@query("regional_forecasters")
def q_regional(spark, sf):
    return forecast.regional_performance(regional_forecasters(spark, sf), region_split(spark, sf))


@query("ensemble_model_metrics")
def q_ensemble(spark, sf):
    rows = scored_test(spark, sf)
    perf = forecast.regional_performance(regional_forecasters(spark, sf), region_split(spark, sf))
    return forecast.model_comparison(
        verify.regression_metrics(rows, "sales", "global_prediction"), perf, verify.regression_metrics(rows, "sales"))


@query("oof_predictions")
def q_oof(spark, sf):
    rows = panel_rows(spark, sf)
    out = forecast.oof_predictions(rows, panel_features(rows))
    return out.select("macro_region", F.col("date").cast("string").alias("date"), "fold", "sales", "prediction")


@query("predict_demand")
def q_predict_demand(spark, sf):
    """Every panel row scored by the blend of both models."""
    both = forecast.predict(global_forecaster(spark, sf), panel_rows(spark, sf), "global_prediction")
    out = forecast.ensemble_forecast(forecast.predict_regional(regional_forecasters(spark, sf), both))
    return out.select("macro_region", F.col("date").cast("string").alias("date"), "global_prediction", "regional_prediction", "prediction")


@query("predict_all_regions")
def q_predict_all(spark, sf):
    """Every panel row scored as a row of every region that has a model."""
    rows = panel_rows(spark, sf).withColumn("asked_from", F.col("macro_region"))
    out = forecast.predict_all_regions(global_forecaster(spark, sf), regional_forecasters(spark, sf), rows)
    return out.select("asked_from", F.col("date").cast("string").alias("date"), "macro_region", "prediction")


@query("feature_importance")
def q_importance(spark, sf):
    return forecast.importance(global_forecaster(spark, sf), panel_features(global_split(spark, sf)))


@query("cv_forecast")
def q_cv_forecast(spark, sf):
    rows = panel_rows(spark, sf)
    folded = cut(panel.walk_forward_folds(rows))
    return once(spark, sf, "cv_forecast", lambda: cut(forecast.cv_forecast(folded, panel_features(rows))))


@query("cv_forecast_summary")
def q_cv_summary(spark, sf):
    return forecast.summarise_folds(q_cv_forecast(spark, sf), ["mae", "rmse", "r2", "mape"])


@query("overfit_forecast")
def q_overfit(spark, sf):
    rows = forecast.predict(global_forecaster(spark, sf), global_split(spark, sf))
    rows = rows.withColumn("split", F.when(F.col("is_train") == 1, "train").otherwise("test"))
    return verify.overfit_check(verify.regression_metrics(rows, "sales", by=["split"]))


@query("learning_curve_forecast")
def q_curve_forecast(spark, sf):
    rows = panel_rows(spark, sf)
    names = panel_features(rows)
    return classify.learning_curve(
        rows.select(*names, F.col("sales").alias("y_sales")), names,
        forecast.boosted_plan(CURVE_BOOSTED, 5, 0.1), "regression", target="y_sales")


@query("permutation_importance_forecast")
def q_perm_forecast(spark, sf):
    rows = global_split(spark, sf)
    return classify.permutation_importance(
        global_forecaster(spark, sf), rows.where("is_train = 0"), panel_features(rows), "regression", target="sales")


# --- Late delivery -----------------------------------------------------------------------


def late_levels(spark, sf):
    return once(spark, sf, "late_levels", lambda: classify.late_inputs(labelled(spark, sf))[2])


def late_rows(spark, sf):
    def build():
        coded, names, _ = classify.late_inputs(labelled(spark, sf))
        return cut(classify.stratified_split(coded.select(*KEYS, "macro_region", *names, "label"))), names

    return once(spark, sf, "late_rows", build)


def late_classifier(spark, sf):
    rows, names = late_rows(spark, sf)
    return once(spark, sf, "late_classifier", lambda: classify.fit_late(rows, names))


def late_regional_rows(spark, sf):
    def build():
        rows, names = late_rows(spark, sf)
        return cut(classify.stratified_split(rows.drop("is_train"), ("macro_region", "label")), by="macro_region")

    return once(spark, sf, "late_regional_rows", build)


def late_regional(spark, sf):
    rows, names = late_regional_rows(spark, sf), late_rows(spark, sf)[1]
    return once(spark, sf, "late_regional", lambda: classify.fit_late_regional(rows, names))


def late_scored(spark, sf):
    rows, _ = late_rows(spark, sf)
    return once(spark, sf, "late_scored", lambda: cut(
        classify.predict_probability(late_classifier(spark, sf), rows).select(*KEYS, "macro_region", "label", "is_train", "score", "predicted")))


@query("late_classifier")
def q_late(spark, sf):
    return classify.classifier_metrics(late_scored(spark, sf).where("is_train = 0"))


@query("regional_classifiers")
def q_late_regional(spark, sf):
    return classify.late_regional_performance(late_regional(spark, sf), late_regional_rows(spark, sf))


@query("attach_late_probability")
def q_attach_late(spark, sf):
    return late_scored(spark, sf).select(*KEYS, F.col("score").alias("late_delivery_probability"))


@query("predict_late")
def q_predict_late(spark, sf):
    rows = late_regional_rows(spark, sf)
    return classify.predict_late(late_classifier(spark, sf), late_regional(spark, sf), rows).select(*KEYS, "macro_region", "score", "predicted")


@query("top_features")
def q_top_features(spark, sf):
    return forecast.importance(late_classifier(spark, sf), late_rows(spark, sf)[1]).limit(15)


@query("cv_classifier")
def q_cv_classifier(spark, sf):
    rows, names = late_rows(spark, sf)
    return classify.cv_classifier(rows, names)


@query("overfit_classifier")
def q_overfit_classifier(spark, sf):
    rows = late_scored(spark, sf).withColumn("split", F.when(F.col("is_train") == 1, "train").otherwise("test"))
    return verify.overfit_check(classify.classifier_metrics(rows, ["split"]), "classification")


@query("learning_curve")
def q_curve(spark, sf):
    rows, names = late_rows(spark, sf)
    return classify.learning_curve(rows.drop("is_train"), names, Plan("forest", CURVE_FOREST, 6), "classification")


@query("permutation_importance")
def q_perm(spark, sf):
    rows, names = late_rows(spark, sf)
    return classify.permutation_importance(late_classifier(spark, sf), rows.where("is_train = 0"), names, "classification")


# --- Fraud, cancellation, composite ------------------------------------------------------


def lean(spark, sf, *columns):
    """Some columns of the feature table's rows, written."""
    return cut(feature_items(spark, sf).select(*columns))


def fraud_rows(spark, sf):
    def build():
        # Not from the feature table, most of whose columns these models leave aside: it need not be written for them. Codes are joined anew by each reader.
        rows = lean(spark, sf, *dict.fromkeys((*KEYS, "order_region", "market", "sales", "order_status", *classify.FRAUD_NUMERIC, *classify.FRAUD_CATEGORIES)))
        coded, names, _ = classify.fraud_inputs(rows)
        return coded.select(*KEYS, "order_region", "market", "sales", *names, "label"), names

    return once(spark, sf, "fraud_rows", build)


def fraud_model(spark, sf):
    rows, names = fraud_rows(spark, sf)
    return once(spark, sf, "fraud_model", lambda: classify.fit_fraud(rows, names))


def cancel_rows(spark, sf):
    def build():
        own = [c for c in classify.CANCEL_NUMERIC if c != "regional_cancel_rate"]
        coded, names, _ = classify.cancel_inputs(lean(spark, sf, *dict.fromkeys(
            (*KEYS, "order_region", "order_status", *own, *classify.CANCEL_CATEGORIES))))
        return cut(classify.stratified_split(coded.select(*KEYS, *names, "label"))), names

    return once(spark, sf, "cancel_rows", build)


def cancel_model(spark, sf):
    rows, names = cancel_rows(spark, sf)
    return once(spark, sf, "cancel_model", lambda: classify.fit_cancel(rows, names))


@query("fraud_model")
def q_fraud(spark, sf):
    rows, names = fraud_rows(spark, sf)
    return classify.fraud_cv_auc(rows, names)


@query("fraud_score")
def q_fraud_score(spark, sf):
    return classify.fraud_score(fraud_model(spark, sf), fraud_rows(spark, sf)[0]).select(*KEYS, "fraud_probability", "fraud_flag", "fraud_risk_tier")


@query("top_suspicious")
def q_suspicious(spark, sf):
    scored = classify.fraud_score(fraud_model(spark, sf), fraud_rows(spark, sf)[0])
    return risk.top_suspicious(scored).select("order_id", "order_region", "sales", "discount_rate", "fraud_probability")


@query("fraud_importance")
def q_fraud_importance(spark, sf):
    return forecast.importance(fraud_model(spark, sf), fraud_rows(spark, sf)[1])


@query("cancel_model")
def q_cancel(spark, sf):
    rows, _ = cancel_rows(spark, sf)
    scored = classify.predict_probability(cancel_model(spark, sf), rows.where("is_train = 0"))
    return classify.classifier_metrics(scored)


@query("cancel_score")
def q_cancel_score(spark, sf):
    return classify.cancel_score(cancel_model(spark, sf), cancel_rows(spark, sf)[0]).select(*KEYS, "cancellation_probability", "cancellation_flag")


# With these, order lines that share all keys are told apart.
MEASURES = ("sales", "quantity", "discount_rate")


def composite(spark, sf):
    """The three fitted models scored in one chain over one table: no join back by position or key."""
    df = labelled(spark, sf)
    coded, _, _ = classify.late_inputs(df, late_levels(spark, sf))  # with levels, rows without a label stay
    out = classify.predict_probability(late_classifier(spark, sf), coded, "p_late", flag=None)
    coded, _, _ = classify.fraud_inputs(out)
    out = classify.predict_probability(fraud_model(spark, sf), coded, "p_fraud", flag=None)
    drop = [f"{c}_code" for c in classify.FRAUD_CATEGORIES]
    coded, _, _ = classify.cancel_inputs(out.drop(*drop))
    out = classify.predict_probability(cancel_model(spark, sf), coded, "p_cancel", flag=None)
    return risk.composite_risk(out.select(*KEYS, *MEASURES, "order_region", "market", "p_late", "p_fraud", "p_cancel"))


@query("composite_model_risk")
def q_composite(spark, sf):
    return composite(spark, sf).drop(*MEASURES)


# --- Persistence -------------------------------------------------------------------------


def bundle_folder(spark):
    return f"{shared_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"


def order_bundle(spark, sf):
    """Folder of a stored bundle that can score raw orders."""
    def build():
        path = bundle_folder(spark)
        models = {"late": late_classifier(spark, sf), "fraud": fraud_model(spark, sf), "cancel": cancel_model(spark, sf)}
        save_bundle(path, models, scoring.encoders(table(spark, sf), late_levels(spark, sf), labeller(spark, sf)))
        return path

    return once(spark, sf, "order_bundle", build)


@query("save_models", f"WITH {PANEL} SELECT macro_region, 0.0::DOUBLE AS largest_difference, count(*) - 30 AS rows FROM panel GROUP BY 1 HAVING count(*) > 30")
def q_save(spark, sf):
    """Save, load again and score: the loaded models give the same numbers (difference 0)."""
    path = bundle_folder(spark)
    rows = global_split(spark, sf)
    model, own = global_forecaster(spark, sf), regional_forecasters(spark, sf)
    save_bundle(path, {"demand/global": model, "demand/regional": own})
    loaded = load_bundle(spark, path).models
    again = forecast.predict_regional(loaded["demand/regional"], forecast.predict(loaded["demand/global"], rows, "g2"), "r2")
    both = forecast.predict_regional(own, forecast.predict(model, again, "g1"), "r1")
    moved = F.greatest(F.abs(F.col("g1") - F.col("g2")), F.abs(F.coalesce("r1", F.lit(0.0)) - F.coalesce("r2", F.lit(0.0))))
    return both.groupBy("macro_region").agg(F.max(moved).alias("largest_difference"), F.count(F.lit(1)).alias("rows"))


@query("load_models", f"WITH {OI} SELECT order_region, count(*) AS orders, 0.0::DOUBLE AS largest_difference FROM oi GROUP BY 1")
def q_load(spark, sf):
    """A stored bundle read back scores all raw orders like the models of this session (difference 0)."""
    bundle = load_bundle(spark, order_bundle(spark, sf))
    names = ("p_late", "p_fraud", "p_cancel", "composite_risk_score")
    keys = [*KEYS, *MEASURES]
    stored = scoring.score_orders(items(spark, sf, *FEATURE_INPUTS), bundle.models, bundle.tables).select(*keys, "order_region", *names)
    own = composite(spark, sf).groupBy(*keys).agg(*[F.max(c).alias(f"own_{c}") for c in names])  # lines equal in all of them have equal scores
    both = stored.join(own, keys, "left")
    moved = F.greatest(*[F.coalesce(F.abs(F.col(c) - F.col(f"own_{c}")), F.lit(1.0)) for c in names])
    return both.groupBy("order_region").agg(F.count(F.lit(1)).alias("orders"), F.max(moved).alias("largest_difference"))


@query("metrics_table")
def q_metrics(spark, sf):
    """Errors of the regional models, stored with them and read back."""
    path = bundle_folder(spark)
    models = regional_forecasters(spark, sf)
    save_bundle(path, {"demand/regional": models}, {"metrics": forecast.regional_performance(models, region_split(spark, sf))})
    return load_bundle(spark, path).tables["metrics"]
