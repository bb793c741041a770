"""Tree ensembles at size: histograms, choice of rows and scores."""

import numpy as np
from pyspark.sql import functions as F

from cargolens.operators import classify, trees


def _grown(kind, depth, many, n=4000, wide=16):
    rng = np.random.default_rng(3)
    values = rng.random((n, wide)).round(2)
    values[::7, 2] = -np.inf
    edges = [np.unique(v[v > -np.inf])[:-1] for v in values.T]
    x = np.stack([np.where(v == -np.inf, 0, 1 + np.searchsorted(e, v, "left")) for v, e in zip(values.T, edges)]).astype(np.uint8)
    y = (rng.random(n) < 0.2 + 0.6 * values[:, 0]).astype(float)
    grown = list(trees._ensemble(x, y, np.ones(n), trees.Plan(kind, many, depth, 0.1), edges, 0, many))
    return values, [tuple(t[i] for i in range(4)) for _, t in grown]


def test_scores_by_masks_are_those_of_walks():
    for kind, depth, many in (("logistic", 6, 150), ("squared", 5, 3), ("forest", 9, 4)):
        x, grown = _grown(kind, depth, many)
        laid = trees.Forest(grown, depth)
        assert laid.masked == (kind != "forest")
        assert np.array_equal(laid.total(x), trees.tree_sum(x, grown, depth))
    alone = [(np.array([-1]), np.array([np.inf]), np.array([0]), np.array([0.25]))]
    assert trees.Forest(alone, 0).total(np.zeros((3, 1))).tolist() == [0.25] * 3


def test_a_forest_counts_only_rows_of_nodes_that_drew_the_feature(monkeypatch):
    """16 features, 4 drawn by a node: a level's histograms take 4 rows for each row, not 32 (16 features, two sums)."""
    seen, plain = [0], np.bincount

    def counting(at, *rest, **named):
        seen[0] += len(at)
        return plain(at, *rest, **named)

    monkeypatch.setattr(np, "bincount", counting)
    _grown("forest", 5, 2)
    assert seen[0] <= 2 * 5 * 4000 * (4 + 3)


def test_rows_are_chosen_before_python_and_joins_shuffle_no_rows(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 3).alias("k"))
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(trees, "cut", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        weighted = classify.balanced_weights(rows, ["k"])
        model = trees.fit(weighted, ["a"], trees.Plan("logistic", 2, 2), "label", F.col("k"), F.col("_w"), train_rows=300)
        lines = plans[0].splitlines()
        python = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
        assert any("Join" in x for x in lines[python + 1:])  # below: before
        assert model.nodes.select("key").distinct().count() == 3
        assert "InMemoryRelation" in plans[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_row_facts_are_joined_once(spark):
    """A subquery is computed anew wherever an expression names it; scaled features named it twice a column."""
    from cargolens.operators import features

    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    for scaled in (features.standard_scale(df, ["a", "b"]), features.minmax_scale(df, ["a", "b"])):
        assert "scalar-subquery" not in scaled._jdf.queryExecution().optimizedPlan().toString()
        assert scaled.columns[:2] == ["a", "b"] and len(scaled.columns) == 4 and scaled.count() == 3
    assert "scalar-subquery" not in classify.balanced_weights(df.withColumn("label", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
