"""Shared-scan K-Means against plain numpy: costs, labels, silhouettes, resting centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import cluster, kmeans


def points(n=400, seed=3):
    draw = np.random.default_rng(seed)
    middle = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]], float)
    return middle[draw.integers(0, 4, n)] + draw.normal(0, 1.0, (n, 3))


def rows(spark, x, parts=5):
    return spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(parts)


def test_costs_labels_and_silhouettes(spark):
    x = points()
    models, scores = kmeans.sweep(rows(spark, x), range(2, 7), starts=4)
    assert sorted(models) == [2, 3, 4, 5, 6]
    for k, m in models.items():
        d = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert m.inertia == pytest.approx(d.min(axis=1).sum()) and m.sizes.tolist() == np.bincount(own, minlength=k).tolist()
        labels = {tuple(r["x"]): r["l"] for r in rows(spark, x).select("x", m.label(F.col("x")).alias("l")).collect()}
        assert [labels[tuple(r)] for r in x.tolist()] == own.tolist()
        # Centres rest: one more round moves them by hardly anything.
        moved = np.stack([x[own == i].mean(axis=0) for i in range(k)])
        assert ((moved - m.centres) ** 2).sum() <= kmeans.REST
        pair = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        mean = np.stack([pair[:, own == i].mean(axis=1) for i in range(k)], axis=1)
        n = np.bincount(own)
        a = mean[np.arange(len(x)), own] * n[own] / (n[own] - 1)
        mean[np.arange(len(x)), own] = np.inf
        b = mean.min(axis=1)
        assert scores[k] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    assert max(scores, key=scores.get) == 4
    costs = [models[k].inertia for k in sorted(models)]
    assert costs == sorted(costs, reverse=True)


def test_layout_does_not_matter(spark):
    x = points(200)
    found = [kmeans.sweep(rows(spark, x, n), [3, 5], starts=3)[0] for n in (1, 4, 30)]
    for k in (3, 5):
        assert all(f[k].inertia == pytest.approx(found[0][k].inertia) for f in found)


def test_equal_rows_and_more_centres_than_points(spark):
    x = np.array([[1.0, 1.0]] * 50 + [[2.0, 2.0]] * 50)
    models, scores = kmeans.sweep(rows(spark, x), [2, 4], starts=2)
    assert models[2].inertia == 0 and sorted(models[2].sizes) == [50, 50] and scores[2] == pytest.approx(1)
    assert models[4].inertia == 0 and models[4].sizes.sum() == 100


def test_no_rows(spark):
    assert kmeans.sweep(spark.createDataFrame([], "x array<double>"), [2, 3]) == ({}, {})


def test_incomplete_rows_get_the_missing_label(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (9.0, 9.0), (9.1, 9.0), (None, 1.0)], "a double, b double")
    _, models = cluster.kmeans_sweep(cluster.with_vector(df.dropna(), ["a", "b"]), [2])
    got = [r["kmeans_cluster"] for r in cluster.attach_labels(df, models[2], ["a", "b"], missing=-1).collect()]
    assert got[0] == got[1] != got[2] == got[3] and got[4] == -1
