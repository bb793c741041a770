"""All rows teach, whatever their number; trees grown by all tasks are those that one task grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import classify, levels, stats, trees
from cargolens.operators.trees import Plan
from cargolens.plans import inputs, models

NAMES = ["a", "b", "c"]


def table(spark, n, keys=1):
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double")
    df = spark.range(n).select((F.col("id") % keys).cast("string").alias("k"), h(1, 12).alias("a"), h(2, 40).alias("b"),
                               F.when(h(4, 50) > 0, h(3, 5)).alias("c"), (h(5, 10) / 4).alias("noise"))
    return df.withColumn("y", (F.col("a") + F.col("b") / 10 + F.col("noise") > 9).cast("double")) \
        .withColumn("w", F.when(F.col("y") == 1, 2.5).otherwise(1.0)).cache()


def scores(df, model, key=None):
    return np.array([r[0] for r in df.select(model.score(key=key)).collect()])


@pytest.mark.parametrize("size", [None, 700])
def test_more_rows_than_one_task_takes_all_teach(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(trees, "TASK_ROWS", size, raising=False)
    df = spark.range(300000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 > 50).cast("double").alias("y"))
    df = df if size is None else df.limit(5000)
    model = trees.fit(df, ["a"], Plan("logistic", 1, 1), "y")
    assert model.nodes.where("tree = -1").first()["cover"] == df.count()


def test_boosted_trees_of_all_tasks_are_those_of_one(spark, monkeypatch):
    df = table(spark, 6000, 2)
    for plan in (Plan("logistic", 8, 4, 0.3), Plan("squared", 6, 3, 0.4)):
        one = scores(df, trees.fit(df, NAMES, plan, "y", F.col("k"), F.col("w")), F.col("k"))
        with monkeypatch.context() as m:
            m.setattr(trees, "TASK_ROWS", 1000)
            m.setattr(levels, "BLOCK", 700)
            m.setattr(levels, "DIRECT", 2)
            assert np.abs(scores(df, trees.fit(df, NAMES, plan, "y", F.col("k"), F.col("w")), F.col("k")) - one).max() < 1e-9


@pytest.mark.parametrize("plan", [Plan("forest", 12, 5), Plan("squared", 6, 4, 0.3, 0.8, 0.7)])
def test_trees_of_all_tasks_do_not_depend_on_layout(spark, monkeypatch, plan):
    monkeypatch.setattr(trees, "TASK_ROWS", 1000)
    monkeypatch.setattr(levels, "BLOCK", 700)
    df = table(spark, 6000)
    found = [scores(df, trees.fit(df.repartition(n), NAMES, plan, "y")) for n in (1, 5)]
    assert np.array_equal(*found)
    y = np.array([r[0] for r in df.select("y").collect()])
    assert np.corrcoef(found[0], y)[0, 1] > 0.8
    assert trees.fit(df, NAMES, plan, "y").nodes.where("tree >= 0").select("tree").distinct().count() == plan.trees


def test_large_and_small_keys_in_one_fit(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 1000)
    df = table(spark, 3000).withColumn("k", F.when(F.col("b") < 4, "small").otherwise("large"))
    for weight in (None, F.col("w")):  # fractions of rows too
        model = trees.fit(df, NAMES, Plan("forest", 60, 4), "y", F.col("k"), weight)
        assert model.keys == ["large", "small"]
        covers = {r["key"]: r["n"] / 60 for r in model.nodes.where("node = 0").groupBy("key").agg(F.sum("cover").alias("n")).collect()}
        rows = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("n")).collect()}
        assert all(covers[k] == pytest.approx(rows[k], rel=0.05) for k in rows)
        assert model.nodes.groupBy("key", "tree", "node").count().where("count > 1").count() == 0


def test_the_curve_of_the_classifier_takes_all_rows(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("is_train"))
    monkeypatch.setattr(models, "late_rows", lambda spark, sf: (rows, ["x"]))
    monkeypatch.setattr(models, "CURVE_FOREST", 3)
    out = models.q_curve(spark, None).collect()
    assert max(r["train_rows"] for r in out) == 6000


def test_bins_of_counted_values(spark, monkeypatch):
    df = spark.range(40000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / 7).alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                   F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 4 == 1, F.lit(float("nan"))).otherwise(F.lit(5.0))).alias("c"))
    a = np.sort(np.array([r[0] for r in df.select("a").collect()]))
    want = a[np.ceil(np.arange(1, 127) / 127 * len(a)).astype(int) - 1]
    exact, b, c = trees.counted_edges(df, NAMES)
    assert np.array_equal(exact, want) and b.tolist() == [0, 1, 2] and c.tolist() == [5.0]
    monkeypatch.setattr(trees, "HELD", 1 << 12)
    monkeypatch.setattr(trees, "HANDED", 1 << 11)
    near = trees.counted_edges(df.repartition(5), NAMES)[0]
    assert np.abs(np.searchsorted(a, near) - np.searchsorted(a, want)).max() < len(a) / 127 / 4


def test_columns_without_values_have_no_bins(spark):
    assert [len(e) for e in trees.counted_edges(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"])] == [0, 1]
    assert [len(e) for e in trees.counted_edges(spark.createDataFrame([], "a double, b double"), ["a", "b"])] == [0, 0]


def test_shift_of_quarters_with_many_rows(spark):
    """The product of four counts of 70,000 outgrows a long."""
    n = 70000
    df = spark.range(2 * n).select(F.lit("r").alias("order_region"), F.when(F.col("id") < n, F.lit("2020-01-05")).otherwise(F.lit("2020-04-05")).cast("date").alias("order_date"),
                                   (F.col("id") % 7).alias("days_real"), (F.col("id") % F.when(F.col("id") < n, 2).otherwise(4) == 0).cast("int").alias("late_risk"))
    row, = stats.distribution_shift(df).collect()
    a, b = n // 2, n // 4
    cross = abs(b * (n - a) - a * (n - b)) - n
    assert row["late_chi2"] == pytest.approx(2 * n * cross ** 2 / ((a + b) * (2 * n - a - b) * n * n)) and row["ks_distance"] == pytest.approx(0, abs=1e-4)


def test_fraud_and_cancel_rows_do_without_the_feature_table(spark, folder, monkeypatch, tmp_path):
    """The rows are those of the feature table, which is not written for them; suppliers and parts that repeat or are missing decide on rows."""
    for name in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if name in ("part", "supplier"):
            key = F.col(f"{name[0]}_{name}key".replace("supplierkey", "suppkey"))
            rows = rows.where(key % 3 > 0).unionByName(rows.where(key % 3 == 1))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    whole = inputs.feature_table(spark, folder).cache()
    fraud, names, _ = classify.fraud_inputs(whole)
    cancel, cancel_names, _ = classify.cancel_inputs(whole)
    cancel = classify.stratified_split(cancel.select(*inputs.KEYS, *cancel_names, "label"))
    monkeypatch.setattr(models, "feature_table", None)
    models.forget()
    try:
        for (rows, found), want, wanted in ((models.fraud_rows(spark, folder), fraud, names), (models.cancel_rows(spark, folder), cancel, cancel_names)):
            assert found == wanted
            plain = lambda df: df.select([F.round(c, 9) if t == "double" else c for c, t in df.dtypes])
            want = want.select(rows.columns)
            assert rows.count() == want.count() and plain(rows).exceptAll(plain(want)).count() == 0
    finally:
        models.forget()
