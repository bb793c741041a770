"""The whole analysis as one call: features, clusters, models, risk, effects, finance, resilience.

Each result is a DataFrame; nothing is written unless the caller writes it. A part that cannot be
computed on the given data (too few regions, one class only) is reported and left out, the others go on.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.operators import aggregate, causal, classify, clean, cluster, features, finance, forecast, panel, risk, stats, verify
from cargolens.session import cut

log = logging.getLogger(__name__)


class Sizes:
    """Sizes of the fitted ensembles; the defaults are the full ones."""

    def __init__(self, forecast=forecast.GLOBAL_TREES, regional_forecast=forecast.REGIONAL_TREES,
                 forest=classify.FOREST_TREES, fraud=classify.FRAUD_TREES, cancel=classify.CANCEL_TREES, clusters=range(2, 11)):
        self.forecast, self.regional_forecast, self.forest = forecast, regional_forecast, forest
        self.fraud, self.cancel, self.clusters = fraud, cancel, clusters


def run(orders: DataFrame, sizes: Sizes | None = None, sample: int | None = None) -> dict[str, DataFrame]:
    """Run every phase on cleaned order items. ``sample`` keeps a fixed random sample after the features."""
    sizes = sizes or Sizes()
    out: dict[str, DataFrame] = {}
    failed: list[tuple[str, str]] = []

    def phase(name: str, build: Callable[[], DataFrame]) -> None:
        try:
            out[name] = build()
        except Exception as problem:  # one failing phase must not stop the others; the caller gets its reason
            log.warning("%s left out: %s", name, problem)
            failed.append((name, f"{type(problem).__name__}: {problem}"))

    table = features.build_features(orders)
    table = cut(table if sample is None else clean.sample_rows(table, sample))

    # Clusters first: their labels feed the panel and the classifier.
    scaled, names = cluster.cluster_features(table)
    scaled = cut(scaled)
    found, models = cluster.kmeans_sweep(cluster.with_vector(scaled, names), sizes.clusters)
    best = found.where("is_best = 1").first()["k"]
    table = cut(cluster.label_all(table, models[best]).withColumn("cluster_label", F.col("kmeans_cluster")))
    out["kmeans"] = found
    phase("regional_stats", lambda: features.regional_stats(table))
    phase("anova", lambda: stats.anova_oneway(table))
    phase("chi_square", lambda: stats.chi_square(table))
    phase("kruskal", lambda: stats.kruskal_wallis(table))

    rows = cut(panel.model_rows(panel.build_panel(table, features.regional_stats(table), panel.dominant_cluster(table))))
    used = [c for c in panel.FORECAST_FEATURES if c in rows.columns]
    split = cut(panel.temporal_split(rows))
    own = cut(panel.regional_split(rows), by=panel.REGION)

    def demand() -> DataFrame:
        general = forecast.fit_global(split, used, sizes.forecast)
        regional = forecast.fit_regional(own, used, sizes.regional_forecast)
        scored = cut(forecast.evaluate_ensemble(general, regional, split))
        return forecast.model_comparison(
            verify.regression_metrics(scored, "sales", "global_prediction"), forecast.regional_performance(regional, own),
            verify.regression_metrics(scored, "sales"))

    phase("demand", demand)

    def order_risk() -> DataFrame:
        coded, inputs, levels = classify.late_inputs(table)
        model = classify.fit_late(cut(classify.stratified_split(coded)), inputs, sizes.forest)
        everything, _, _ = classify.late_inputs(table, levels)  # orders without a label are scored too
        scored = classify.predict_probability(model, everything, "p_late", flag=None)
        coded, inputs, _ = classify.fraud_inputs(scored.drop("label"))
        coded = cut(coded)
        scored = classify.predict_probability(classify.fit_fraud(coded, inputs, sizes.fraud), coded, "p_fraud", flag=None)
        coded, inputs, _ = classify.cancel_inputs(scored.drop("label", *[f"{c}_code" for c in classify.FRAUD_CATEGORIES]))
        marked = cut(classify.stratified_split(coded))
        scored = classify.predict_probability(classify.fit_cancel(marked, inputs, sizes.cancel), marked, "p_cancel", flag=None)
        return cut(risk.composite_risk(scored.select("order_id", "order_region", "market", "late_risk", "p_late", "p_fraud", "p_cancel")))

    phase("risk", order_risk)
    if "risk" in out:
        phase("risk_tiers", lambda: risk.risk_tier_pivot(out["risk"]))
        cost_fn = table.transform(finance.fn_fp_costs).first()["cost_fn"]
        phase("cost_threshold", lambda: finance.cost_threshold(out["risk"], cost_fn, score="p_late", label="late_risk"))
    phase("effect", lambda: causal.ate_psm(cut(causal.causal_prepare(table))))
    phase("pareto", lambda: finance.pareto_front(finance.mode_tradeoff(table)))
    phase("esg", lambda: finance.esg_summary(finance.esg_score(table)))
    phase("resilience", lambda: cluster.resilience_index(aggregate.cluster_metrics(table)))
    phase("drift", lambda: cluster.cluster_drift(table))
    phase("hotspots", lambda: aggregate.insight_hotspots(table))
    phase("top_share", lambda: aggregate.insight_top_share(table))
    out["failures"] = orders.sparkSession.createDataFrame(failed, "phase string, reason string")
    return out
