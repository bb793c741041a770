"""Finding F10 of round 3: a dense cloud is connected without comparing its points cell by cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import cluster, density
from tests.test_scale import brute_dbscan


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")


def test_a_dense_cloud_is_tied_before_points_are_compared(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 0.5, (4000, 3))
    seen, real = [], density._touching

    def watched(c, core, *apart):
        seen.append(apart[0].count() if apart else c.pairs.where("a < b and not full").count())
        return real(c, core, *apart)

    monkeypatch.setattr(density, "_touching", watched)
    got = {r["id"]: r["label"] for r in density.dbscan(frame(spark, x), ["a", "b", "c"], 0.3, 10).collect()}
    want, _ = brute_dbscan(x, 0.3, 10)
    assert [got[i] for i in range(len(x))] == list(want)
    pairs = density._Cells(frame(spark, x), ["a", "b", "c"], 0.3).pairs.where("a < b").count()
    assert sum(seen) < pairs / 20


@pytest.mark.parametrize("limit", [100_000, 10])
@pytest.mark.parametrize("gap", [0.49, 0.51])
def test_clouds_at_the_radius_link_by_their_nearest_points_only(spark, monkeypatch, limit, gap):
    """Two balls and a rod whose nearest points lie just within or just beyond the radius, far from any middle of a cell."""
    monkeypatch.setattr(density, "SPLIT_ABOVE", limit)
    rng = np.random.default_rng(7)
    ball = rng.normal(size=(150, 3))
    ball = ball / np.linalg.norm(ball, axis=1)[:, None] * rng.random((150, 1)) ** (1 / 3)
    ball[0], ball[1] = (1, 0, 0), (-1, 0, 0)
    x = np.r_[ball, ball + [2 + gap, 0, 0], np.c_[np.full(60, 10.0), np.linspace(0, 6, 60), np.zeros(60)], rng.uniform(-3, 12, (60, 3))]
    want, _ = brute_dbscan(x, 0.5, 4)
    got = {r["id"]: r["label"] for r in density.dbscan(frame(spark, x), ["a", "b", "c"], 0.5, 4).collect()}
    assert [got[i] for i in range(len(x))] == list(want)
    assert (want[0] == want[150]) == (gap < 0.5)


def test_blocks_of_cells_are_dealt_over_the_cores(spark):
    c = density._Cells(frame(spark, np.random.default_rng(1).normal(size=(500, 3))), ["a", "b", "c"], 0.3)
    pairs = c._candidates()
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1


def test_sweep_keeps_the_order_of_its_radii(spark):
    x = np.r_[np.random.default_rng(2).normal(0, 0.2, (60, 3)), np.random.default_rng(3).normal(4, 0.2, (60, 3)), [[50.0, 0, 0]]]
    found = cluster.dbscan_sweep(frame(spark, x), ["a", "b", "c"], (9.0, 0.5, 1.5, 0.5), 5).collect()
    assert [r["eps"] for r in found] == [9.0, 0.5, 1.5, 0.5]
    for r in found:
        label, _ = brute_dbscan(x, r["eps"], 5)
        assert (r["clusters"], r["noise"]) == (label.max() + 1, (label < 0).sum())
