"""Keyed tree ensembles against trees grown by enumeration, and their independence of layout and company."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import classify, forecast, trees
from cargolens.operators.trees import LEAST_CURVE, PENALTY, Plan


def brute_tree(x, g, h, depth, penalty, least):
    """{leaf rows: value} by trying every split of every column between neighbouring values."""
    def best(rows):
        total = (g[rows].sum(), h[rows].sum())
        found = (1e-9, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= v]
                a, b = g[left].sum(), h[left].sum()
                c, d = total[0] - a, total[1] - b
                if b < least or d < least:
                    continue
                gain = a * a / (b + penalty) + c * c / (d + penalty) - total[0] ** 2 / (total[1] + penalty)
                if gain > found[0] + 1e-9 * abs(found[0]):
                    found = (gain, (f, v))
        return found[1]

    def grow(rows, depth):
        split = best(rows) if depth else None
        if split is None:
            out[rows] = g[rows].sum() / (h[rows].sum() + penalty)
            return
        f, v = split
        grow(rows[x[rows, f] <= v], depth - 1)
        grow(rows[x[rows, f] > v], depth - 1)

    out = np.zeros(len(g))
    grow(np.arange(len(g)), depth)
    return out


def sample(n=160, seed=5):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 12, n), draw.integers(0, 40, n), draw.integers(0, 3, n)], axis=1).astype(float)
    y = 3 * (x[:, 0] > 5) + 0.1 * x[:, 1] * (x[:, 2] == 1) + draw.normal(0, 0.2, n)
    return x, y


def frame(spark, x, y, **more):
    rows = [(*map(float, r), float(t), *[v[i] for v in more.values()]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["a", "b", "c", "y", *more])


def scores(df, model, key=None):
    return {tuple(r[:-1]): r[-1] for r in df.select("a", "b", "c", "y", model.score(key=key).alias("s")).collect()}


def test_boosted_regression_equals_enumeration(spark):
    x, y = sample()
    model = trees.fit(frame(spark, x, y), ["a", "b", "c"], Plan("squared", 4, 3, rate=0.3), "y")
    want = np.full(len(y), y.mean())
    for _ in range(4):
        want += 0.3 * brute_tree(x, y - want, np.ones(len(y)), 3, PENALTY, LEAST_CURVE)
    got = scores(frame(spark, x, y), model)
    assert all(got[(*r, t)] == pytest.approx(w, abs=1e-9) for r, t, w in zip(x.tolist(), y.tolist(), want))


def test_boosted_classes_equal_enumeration(spark):
    x, y = sample()
    y = (y > 2).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    df = frame(spark, x, y).withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    model = trees.fit(df, ["a", "b", "c"], Plan("logistic", 3, 2, rate=0.5), "y", weight=F.col("w"))
    mean = (w * y).sum() / w.sum()
    f = np.full(len(y), math.log(mean / (1 - mean)))
    for _ in range(3):
        p = 1 / (1 + np.exp(-f))
        f += 0.5 * brute_tree(x, w * (y - p), w * p * (1 - p), 2, PENALTY, LEAST_CURVE)
    got = scores(df, model)
    assert all(got[(*r, t)] == pytest.approx(1 / (1 + math.exp(-v)), abs=1e-9) for r, t, v in zip(x.tolist(), y.tolist(), f))


def test_models_of_keys_are_those_fitted_alone(spark):
    x, y = sample(240)
    df = frame(spark, x, y, k=[("r1", "r2", None)[i % 3] for i in range(240)])
    plan = Plan("squared", 6, 3, 0.2, 0.8, 0.7)
    both = trees.fit(df, ["a", "b", "c"], plan, "y", F.col("k"))
    assert both.keys == ["r1", "r2"]
    alone = trees.fit(df.where("k = 'r1'"), ["a", "b", "c"], plan, "y", F.col("k"))
    assert [len(e) for e in trees.bin_edges(df, ["a", "b", "c"])][::2] == [12, 3]
    some = df.where("k = 'r1'")
    a, b = scores(some, both, F.col("k")), scores(some, alone, F.col("k"))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert set(scores(df.where("k is null"), both, F.col("k")).values()) == {None}


@pytest.mark.parametrize("kind", ["squared", "forest"])
def test_layout_does_not_matter(spark, kind):
    x, y = sample(300)
    df = frame(spark, x, (y > 2).astype(float) if kind == "forest" else y)
    plan = Plan(kind, 30, 4, 0.2 if kind == "squared" else 1.0, 0.8, 0.7)
    found = [scores(df, trees.fit(df.repartition(n), ["a", "b", "c"], plan, "y")) for n in (1, 4, 33)]
    assert found[0] == found[1] == found[2]


def test_forest_votes_and_importance(spark):
    x, y = sample(400)
    df = frame(spark, x, (x[:, 0] > 5).astype(float))
    model = trees.fit(df, ["a", "b", "c"], Plan("forest", 60, 4), "y")
    got = scores(df, model)
    assert all((s >= 0.5) == (k[3] == 1) and 0 <= s <= 1 for k, s in got.items())
    shares = {r["feature"]: r["importance"] for r in model.importance().collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > 0.7
    assert model.nodes.select("tree").distinct().count() == 60


def test_missing_values_lie_below_all_others(spark):
    rows = [(None, 1.0)] * 30 + [(float("nan"), 1.0)] * 10 + [(float(i % 5), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = trees.fit(df, ["a"], Plan("logistic", 20, 2, 0.3), "y")
    got = df.select("y", model.score().alias("s")).collect()
    assert all((r["s"] > 0.5) == (r["y"] == 1) for r in got)


def test_odd_training_tables(spark):
    schema = "a double, y double, k string"
    plan = Plan("squared", 3, 2)
    empty = trees.fit(spark.createDataFrame([], schema), ["a"], plan, "y", F.col("k"))
    assert empty.keys == [] and empty.importance().count() == 1
    one = trees.fit(spark.createDataFrame([(1.0, 5.0, "x"), (2.0, None, "x"), (2.0, 7.0, None)], schema), ["a"], plan, "y", F.col("k"))
    assert spark.createDataFrame([(9.0, "x"), (9.0, "z")], "a double, k string").select(one.score(key=F.col("k")).alias("s")).collect() == [(5.0,), (None,)]


def test_training_rows_are_bounded(spark):
    df = spark.range(4000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 > 50).cast("double").alias("y"), (F.col("id") % 2).alias("k"), "id")
    df = df.withColumn("a", F.col("a") + F.col("id") / 1e6)
    model = trees.fit(df, ["a"], Plan("logistic", 5, 2), "y", F.col("k"), train_rows=500)
    seen = [r["cover"] for r in model.nodes.where("tree = -1").collect()]
    assert len(seen) == 2 and all(400 < n < 600 for n in seen)


def test_folds_never_teach_their_own_model(spark):
    """A row's target can only be known to models of other folds: with targets at random, scores must know nothing."""
    draw = np.random.default_rng(0)
    rows = [(float(i), float(draw.normal()), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, sales double, fold int")
    out = forecast.oof_predictions(df.drop("fold"), ["a"], trees=30, depth=4)
    r = out.agg(F.corr("sales", "prediction")).first()[0]
    assert out.count() == 500 and r < 0.2
    own = classify.other_folds(df, 5).groupBy("_model", "fold").count().collect()
    assert len(own) == 20 and all(r["_model"] != r["fold"] for r in own)
