"""Invariants of the fitted jobs on small data."""

import math

import pytest
from pyspark.sql import functions as F

from cargolens.operators import causal, classify, cluster, explain, forecast


@pytest.fixture(scope="module")
def rows(spark):
    """Label depends on a and on the mode; b is noise."""
    data = []
    for i in range(600):
        a, b, mode = (i * 37 % 100) / 100, (i * 53 % 97) / 97, ("x", "y", "z")[i % 3]
        data.append((i, "r1" if i % 2 else "r2", a, b, mode, int(a + (0.3 if mode == "x" else 0.0) > 0.6)))
    return spark.createDataFrame(data, "id int, macro_region string, a double, b double, mode string, label int")


@pytest.fixture(scope="module")
def fitted(rows):
    split = classify.stratified_split(rows).cache()
    return split, classify.fit_late(split, ["a", "b"], trees=10, depth=4)


def test_forest_ranks_better_than_chance_and_repeats(fitted):
    split, model = fitted
    test = classify.predict_probability(model, split.where("is_train = 0"))
    first = classify.classifier_metrics(test).first()
    assert first["auc"] > 0.8
    again = classify.fit_late(split, ["a", "b"], trees=10, depth=4)
    assert classify.classifier_metrics(classify.predict_probability(again, split.where("is_train = 0"))).first() == first


def test_attributions_sum_to_the_score(fitted):
    split, model = fitted
    phi = explain.shapley_sample(model, split, ["a", "b"], ["id"], rows=8, background=5)
    for r in phi.groupBy("id").agg(F.sum("phi").alias("s"), F.max("f_row").alias("f"), F.max("f_background").alias("g")).collect():
        assert math.isclose(r["s"], r["f"] - r["g"], abs_tol=1e-9)


def test_surrogate_blames_the_feature_that_matters(fitted):
    split, model = fitted
    some = split.where("a > 0.9").limit(3)
    out = explain.local_surrogate(model, split, some, ["a", "b"], ["id"], copies=300)
    got = out.collect()
    assert len(got) == 6
    lead = {r["id"]: r["feature"] for r in sorted(got, key=lambda r: abs(r["weight"]))}
    assert set(lead.values()) == {"a"}


def test_shuffling_a_useless_column_costs_nothing_much(fitted):
    split, model = fitted
    out = {r["feature"]: r["mean_drop"] for r in classify.permutation_importance(model, split.where("is_train = 0"), ["a", "b"], "classification", repeats=3).collect()}
    assert out["a"] > 0.1 > abs(out["b"])


def test_inertia_falls_with_k(spark, rows):
    table, _ = cluster.kmeans_sweep(cluster.with_vector(rows, ["a", "b"]), range(2, 6))
    inertia = [r["inertia"] for r in table.orderBy("k").collect()]
    assert all(x > y for x, y in zip(inertia, inertia[1:]))


def test_blend_follows_its_formula(spark):
    df = spark.createDataFrame([(10.0, 20.0), (10.0, None)], "global_prediction double, regional_prediction double")
    assert [r["prediction"] for r in forecast.ensemble_forecast(df).collect()] == [pytest.approx(17.0), 10.0]


def test_linear_effect_of_a_known_model(spark):
    rows = [(t, c, 2 * t + 3 * c) for t in (0, 1) for c in range(10) for _ in range(3)]
    df = spark.createDataFrame(rows, "treated int, c int, outcome int")
    out = causal.ate_linear(df, ["c"]).first()
    assert out["ate"] == pytest.approx(2.0) and out["std_error"] == pytest.approx(0.0, abs=1e-6)


def test_placebo_is_small_and_noise_changes_little(spark):
    rows = [(i % 7, int((i * 7919) % 10 < 5), 0) for i in range(2000)]
    rows = [(c, t, int(t == 0 or c == 3)) for c, t, _ in rows]
    df = spark.createDataFrame(rows, "c int, treated int, outcome int").withColumn("n", F.monotonically_increasing_id() % 5)
    effect = causal.ate_psm(df, ["c"]).first()["ate"]
    assert effect < -0.5
    assert abs(causal.refute_placebo(df, ["c", "n"]).first()["ate"]) < 0.15
    limits = causal.ate_ci(df, ["c"], replicates=20).first()
    assert limits["ci_low"] <= effect + 0.05 and limits["ci_high"] >= effect - 0.05


def test_scenario_costs_and_empty_scenarios(spark, fitted, rows):
    df = spark.createDataFrame([("Standard Class", 10.0), ("Same Day", 5.0)], "shipping_mode string, profit double")
    out = causal.whatif_cost(df, "profit > 0", "First Class").first()
    assert (out["orders_affected"], out["shipping_cost_delta"], out["baseline_profit"]) == (2, -2.0, 15.0)


def test_whole_pipeline_runs_on_small_data(spark, folder):
    from cargolens.plans.inputs import FEATURE_INPUTS
    from cargolens.plans.pipeline import Sizes, run
    from cargolens.sources.orders import order_items

    out = run(order_items(spark, folder, FEATURE_INPUTS), Sizes(2, 1, 3, 2, 2, range(2, 4)))
    assert {"kmeans", "demand", "risk", "effect", "pareto", "esg", "resilience", "drift", "cost_threshold"} <= set(out)
    assert out["risk"].count() == order_items(spark, folder, ["sales"]).count()
