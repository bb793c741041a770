"""Registered queries do the whole job: full ensembles, all rows, all starts."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cargolens.operators import causal as effects
from cargolens.operators import classify, cluster, explain, forecast
from cargolens.plans import causal, models


@pytest.mark.parametrize("build,module,fit", [
    ("global_forecaster", forecast, "fit_global"), ("regional_forecasters", forecast, "fit_regional"), ("late_classifier", classify, "fit_late"),
    ("late_regional", classify, "fit_late_regional"), ("fraud_model", classify, "fit_fraud"), ("cancel_model", classify, "fit_cancel"),
    ("q_fraud", classify, "fraud_cv_auc"), ("q_cv_classifier", classify, "cv_classifier")])
def test_registered_fits_use_the_default_sizes(monkeypatch, build, module, fit):
    given = []
    monkeypatch.setattr(module, fit, lambda *a, **k: given.append((a, k)))
    monkeypatch.setattr(models, "once", lambda spark, folder, name, make: make())
    for name in ("global_split", "region_split"):
        monkeypatch.setattr(models, name, lambda spark, sf: None)
    for name in ("late_rows", "late_regional_rows", "fraud_rows", "cancel_rows"):
        monkeypatch.setattr(models, name, lambda spark, sf: (None, []))
    monkeypatch.setattr(models, "panel_features", lambda rows: [])
    getattr(models, build)(None, None)
    (positional, named), = given
    assert len(positional) == 2 and not named


def test_regression_curve_takes_all_rows(spark, monkeypatch):
    rows = spark.range(6000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("sales"))
    monkeypatch.setattr(models, "panel_rows", lambda spark, sf: rows)
    monkeypatch.setattr(models, "panel_features", lambda rows: ["x"])
    out = models.q_curve_forecast(spark, None).collect()
    assert max(r["train_rows"] for r in out) == 4000 and all(r["validation_mean"] > 0.95 for r in out)


def test_batch_explain_uses_the_default_copies(monkeypatch):
    given = []
    monkeypatch.setattr(explain, "batch_explain", lambda *a, **k: given.append((a, k)))
    monkeypatch.setattr(explain, "riskiest", lambda *a: None)

    class Rows:
        def select(self, *a):
            return self

        def join(self, *a):
            return self

    monkeypatch.setattr(causal, "late_rows", lambda spark, sf: (Rows(), []))
    monkeypatch.setattr(causal, "late_scored", lambda spark, sf: Rows())
    monkeypatch.setattr(causal, "late_classifier", lambda spark, sf: None)
    causal.q_batch(None, None)
    assert "copies" not in given[0][1] and len(given[0][0]) == 5


def test_sweep_keeps_the_best_of_ten_starts(spark):
    rows = cluster.with_vector(spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b")), ["a", "b"])
    table, models = cluster.kmeans_sweep(rows, [7])
    alone = [cluster.kmeans_sweep(rows, [7], starts=1, seed=s)[0].first()["inertia"] for s in (42, 1, 2)]
    assert table.first()["inertia"] == models[7].inertia <= min(alone) * 1.05 and models[7].inertia <= alone[0]


@pytest.mark.parametrize("mean", [1, 7, 200, 201, 230])
def test_bootstrap_draws_are_poisson_at_every_size(mean):
    shares = [0.0005, 0.003, 0.02, 0.31, 0.5, 0.77, 0.98, 0.997, 0.9995]
    got = effects._poisson.func(pd.Series([mean] * len(shares)), pd.Series(shares)).tolist()
    below = lambda n: math.fsum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n))
    assert all(below(n) <= u < below(n + 1) for n, u in zip(got, shares))
    assert effects._poisson.func(pd.Series([0]), pd.Series([0.9])).tolist() == [0]
