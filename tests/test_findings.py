"""Repeated rows, large ids, null regions and labels, incomplete rows: none of them may change or lose a result."""

import pytest
from pyspark.sql import functions as F

from cargolens.operators import causal, classify, cluster, density, forecast, scale, trees


def test_placebo_deals_equal_rows_at_random(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("c"), (F.col("id") % 2).cast("int").alias("treated"), (F.col("id") % 2).cast("int").alias("outcome"))
    # Treatment decides the outcome here, and the rows are of 14 kinds: a dealt-out treatment must not.
    for seed in (1, 2, 3):
        assert abs(causal.refute_placebo(rows, ["c"], seed).first()["ate"]) < 0.03


def test_noise_covariate_is_not_rounded(spark):
    rows = spark.range(3000).select(F.lit(1).alias("c"), (F.col("id") % 2).cast("int").alias("treated"), (F.col("id") % 3 == 0).cast("int").alias("outcome"))
    assert abs(causal.refute_random_cause(rows, ["c"]).first()["ate"]) < 0.15


def test_rank_order_of_integers_beyond_doubles(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + i, 1) for i in range(40)], "v long, n long")
    got = {r["v"]: (r["k_before"], r["k_ties"]) for r in scale.running_totals(df, "v", {"k": "n"}).collect()}
    assert got == {big + i: (i, 1) for i in range(40)}


def test_density_clusters_with_large_ids_stay_apart(spark):
    big = 1 << 60
    points = [(big + i, (i % 2) * 10.0 + i * 0.001, 0.0) for i in range(40)]
    labels = {r["id"]: r["label"] for r in density.dbscan(spark.createDataFrame(points, "id long, a double, b double"), ["a", "b"], 0.5, 3).collect()}
    assert {labels[big + i] for i in range(0, 40, 2)} == {0} and {labels[big + i] for i in range(1, 40, 2)} == {1}


def test_numbers_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "EXPAND", 300)
    rows = spark.range(4000).select((F.col("id") % 2).alias("v"), F.when(F.col("id") < 10, F.col("id")).alias("w"))
    found = scale.numbered(rows).collect()
    assert sorted(r["_index"] for r in found) == list(range(4000)) and {r["_index_size"] for r in found} == {4000}
    assert sorted((r["v"], r["w"] is None, r["w"] or 0) for r in found) == sorted((i % 2, i >= 10, i if i < 10 else 0) for i in range(4000))
    assert scale.numbered(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_random_orders_are_one_to_one(spark, n):
    at = lambda seed: [r[0] for r in spark.range(n).select(scale.permuted(F.col("id"), F.lit(n), F.lit(seed))).collect()]
    first = at(1)
    assert sorted(first) == list(range(n)) and (n < 10 or (first != at(2) and first != sorted(first)))
    if n == 4097:  # halves mix: about half of the lower numbers land in the upper half
        assert 900 < sum(v >= n // 2 for v in first[:n // 2]) < 1150


def test_deals_do_not_depend_on_the_layout(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("c"), (F.hash("id") % 2 == 0).cast("int").alias("treated"), (F.hash("id") % 3 == 0).cast("int").alias("outcome"))
    for refute in (causal.refute_placebo, causal.refute_random_cause):
        found = [refute(rows.repartition(n), ["c"]).first()["ate"] for n in (1, 4, 64, 4)]
        assert found[0] == pytest.approx(found[1], abs=1e-12) and found[1] == pytest.approx(found[2], abs=1e-12) and found[1] == found[3]
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("a"), (F.hash("id") % 5).cast("double").alias("b"), (F.col("id") % 50 > 20).cast("int").alias("label"))
    model = classify.fit_late(df.withColumn("is_train", F.lit(1)), ["a", "b"], 10, 4)
    drops = [{tuple(r) for r in classify.permutation_importance(model, df.repartition(n), ["a", "b"], "classification", 3).collect()} for n in (1, 9)]
    assert drops[0] == drops[1]


@pytest.mark.parametrize("models", [{}, {"r1": 1.0}])
def test_rows_of_unknown_regions_are_predicted(spark, models):
    df = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "macro_region string, id int")
    late = classify.predict_late(trees.constant(spark, {"": 0.25}), trees.constant(spark, models), df).collect()
    assert {r["id"]: r["score"] for r in late} == {1: models.get("r1", 0.25), 2: 0.25, 3: 0.25}
    own = forecast.predict_regional(trees.constant(spark, models), df).collect()
    assert {r["id"]: r["regional_prediction"] for r in own} == {1: models.get("r1"), 2: None, 3: None}


def test_no_region_with_a_model(spark):
    df = spark.createDataFrame([("r1", 1, 0, 5.0)], "macro_region string, label int, is_train int, sales double")
    assert classify.late_regional_performance(trees.constant(spark, {}), df).count() == 0
    assert forecast.predict_all_regions(trees.constant(spark, {"": 1.0}), trees.constant(spark, {}), df).count() == 0
    assert forecast.predict_all_regions(trees.constant(spark, {"": 1.0}), trees.constant(spark, {"a": 2.0, "b": 3.0}), df).count() == 2


def test_unlabelled_orders_are_coded_with_fitted_levels(spark):
    df = spark.createDataFrame([(1, "Same Day"), (0, "First Class"), (None, "Same Day")], "late_risk int, shipping_mode string")
    coded, _, levels = classify.late_inputs(df)
    assert coded.count() == 2 and classify.late_inputs(df, levels)[0].count() == 3


def test_incomplete_rows_keep_a_label(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 5)) for i in range(30)] + [(100, None, 1.0), (101, 2.0, float("nan"))], "id int, sales double, quantity double")
    scaled, names = cluster.cluster_features(df)
    _, models = cluster.kmeans_sweep(cluster.with_vector(scaled, names), [2])
    out = {r["id"]: r["kmeans_cluster"] for r in cluster.label_all(df, models[2]).collect()}
    assert len(out) == 32 and out[100] == out[101] == 0


def test_silhouette_and_density_sweep_use_all_rows(spark):
    df = spark.createDataFrame([(i, (i % 2) * 100.0 + i % 3, 0.5, i % 2) for i in range(60)], "id long, a double, b double, label int")
    found = cluster.silhouette(df, ["a", "b"], "label").first()
    assert found["rows"] == 60 and found["silhouette"] > 0.99
    sweep = {r["eps"]: r for r in cluster.dbscan_sweep(df, ["a", "b"], (1.5,)).collect()}
    assert sweep[1.5]["clusters"] == 2 and sweep[1.5]["noise"] == 0 and sweep[1.5]["is_best"] == 1


def test_normal_quantile_equals_the_library(spark):
    from statistics import NormalDist

    from cargolens.functions.pvalues import normal_quantile

    p = [0.0, 1.0, 1e-300, 1e-12, 0.001, 0.07, 0.0749999, 0.3, 0.5, 0.9, 0.925, 0.9999999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile("p").alias("q")).collect()
    for r in got:
        assert r["q"] is None if r["p"] in (0.0, 1.0) else abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-9


def test_many_ties_have_all_their_ranks(spark):
    from cargolens.operators import stats

    df = spark.range(10_000).select((F.col("id") % 10 == 0).cast("double").alias("y"), F.lit(0.0).alias("prediction"))
    points = stats.qq_points(df).collect()
    assert sorted(r["rank"] for r in points) == list(range(1, 10_001)) and sum(r["residual"] for r in points) == 1000
