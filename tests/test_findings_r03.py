"""What the findings of round 3 asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import kmeans, trees
from cargolens.operators.kmeans import Centres
from cargolens.plans import causal as causal_plans
from cargolens.plans import inputs, load_all, models
from cargolens.plans.registry import QUERIES

load_all()


@pytest.mark.parametrize("query", ["q_whatif", "q_compare"])
def test_whatif_scores_rows_with_their_clusters(spark, folder, monkeypatch, query):
    """The late classifier reads the cluster label, so scenarios have to carry it."""
    models.forget()
    monkeypatch.setattr(models, "best_centres", lambda *_: Centres(np.zeros((1, 10)), 0.0, np.ones(1)))
    monkeypatch.setattr(causal_plans, "late_classifier", lambda *_: trees.constant(spark, {"": 0.25}, ["kmeans_cluster"]))
    try:
        assert getattr(causal_plans, query)(spark, folder).collect()
    finally:
        models.forget()


def test_blocks_of_few_files_are_dealt_over_the_cores(spark):
    x = np.random.default_rng(1).normal(size=(40_000, 3))
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>").coalesce(1)
    blocks = kmeans.pack(rows)
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert blocks.where("n > 0").select(F.spark_partition_id()).distinct().count() > 1
    assert blocks.agg(F.sum("n")).first()[0] == len(x) and blocks.agg(F.max("n")).first()[0] == kmeans.BLOCK


def test_a_round_gives_ties_to_the_first_centre(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [5.0, 5.0]])  # the third lies between both centres
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>")
    states = {(2, 0): np.array([[0.0, 0.0], [2.0, 0.0]]), (1, 3): np.array([[1.0, 1.0]])}
    found = kmeans._round(kmeans.pack(rows), states)
    n, cost, square, sums = found[2, 0]
    assert n.tolist() == [2, 2] and cost.sum() == pytest.approx(0 + 0 + 1 + 34) and square.tolist() == [1, 54]
    assert sums.tolist() == [[1.0, 0.0], [7.0, 5.0]]
    assert found[1, 3][0].tolist() == [4] and found[1, 3][3].tolist() == [[8.0, 5.0]]


def _reads_lines(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_rows_read_several_times_are_joined_once(spark, folder):
    assert not _reads_lines(inputs.feature_table(spark, folder))
    assert not _reads_lines(inputs.written(spark, folder, "order_id", "market"))
    assert _reads_lines(inputs.items(spark, folder, "order_id", "market"))
    for name in ("esg_score", "shipping_days_box", "regional_stats_ext", "panel_merge", "impute_numeric_median"):
        assert not _reads_lines(QUERIES[name](spark, folder)), name
