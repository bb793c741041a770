"""Bundles: versions, shared tables, commits, and scoring of raw orders by what was stored alone."""

import pytest
from pyspark.sql import functions as F

from cargolens.operators import classify, cluster, features, scoring, trees
from cargolens.operators.trees import Plan
from cargolens.plans.inputs import FEATURE_INPUTS, KEYS
from cargolens.schema import CSV_COLUMNS
from cargolens.session import shared_dir
from cargolens.sources import models
from cargolens.sources.orders import load_orders_csv, order_items


@pytest.fixture()
def path(spark, tmp_path):
    return str(tmp_path / "bundle")


def small_model(spark, plus=0.0):
    df = spark.range(60).select((F.col("id") % 10).cast("double").alias("a"), ((F.col("id") % 10) * 2.0 + plus).alias("y"), F.when(F.col("id") % 2 == 0, "A/B").otherwise("A_B").alias("k"))
    return df, trees.fit(df, ["a"], Plan("squared", 5, 3, 0.5), "y", F.col("k"))


def test_versions_and_shared_tables(spark, path):
    df, model = small_model(spark)
    _, other = small_model(spark, 1.0)
    codes = spark.createDataFrame([("x", 1), ("y", 2)], "level string, code int")
    assert models.versions(spark, path) == []
    assert models.save_bundle(path, {"m": model}, {"codes": codes}) == 1
    assert models.save_bundle(path, {"m": other, "again": model}, {"codes": codes.orderBy(F.desc("code"))}) == 2
    first, last = models.load_bundle(spark, path, 1), models.load_bundle(spark, path)
    assert (first.version, last.version) == (1, 2) and models.versions(spark, path) == [1, 2]
    folders = spark.read.json(f"{path}/manifests").groupBy("name").agg(F.count_distinct("folder").alias("n")).collect()
    assert {r["name"]: r["n"] for r in folders} == {"m": 2, "again": 1, "codes": 1}
    scored = df.select("k", model.score(key=F.col("k")).alias("s"), first.models["m"].score(key=F.col("k")).alias("t"),
                       last.models["again"].score(key=F.col("k")).alias("u"), last.models["m"].score(key=F.col("k")).alias("v")).collect()
    assert all(r["s"] == r["t"] == r["u"] and r["v"] == pytest.approx(r["s"] + 1, abs=0.2) for r in scored)
    with pytest.raises(ValueError, match="version 7"):
        models.load_bundle(spark, path, 7)


def test_a_version_is_committed_once(spark, path, monkeypatch):
    _, model = small_model(spark)
    models.save_bundle(path, {"m": model})
    monkeypatch.setattr(models, "versions", lambda spark, path: [])  # a second writer that has not seen version 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        models.save_bundle(path, {"m": model})


def test_digest_is_of_the_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert models.digest(a) == models.digest(a.orderBy(F.desc("i")).repartition(3)) == models.digest(a.select("s", "i"))
    assert len({models.digest(x) for x in (a, a.distinct(), a.limit(0), a.withColumn("i", F.col("i").cast("long")), a.withColumnRenamed("i", "j"))}) == 5


@pytest.fixture(scope="module")
def trained(spark, folder, tmp_path_factory):
    raw = order_items(spark, folder, FEATURE_INPUTS)
    table = features.build_features(raw).cache()
    scaled, names = cluster.cluster_features(table)
    _, centres = cluster.kmeans_sweep(cluster.with_vector(scaled, names), [3], starts=2)
    labeller = cluster.Labeller.of(table, centres[3])
    labelled = labeller.label(table).cache()
    late, late_names, levels = classify.late_inputs(labelled)
    fraud, fraud_names, _ = classify.fraud_inputs(labelled)
    cancel, cancel_names, _ = classify.cancel_inputs(labelled)
    marked = F.lit(1).alias("is_train")
    fitted = {"late": classify.fit_late(late.withColumn("is_train", marked), late_names, 10, 5), "fraud": classify.fit_fraud(fraud, fraud_names, 10, 3),
              "cancel": classify.fit_cancel(cancel.withColumn("is_train", marked), cancel_names, 10, 3)}
    path = str(tmp_path_factory.mktemp("bundles") / "orders")
    models.save_bundle(path, fitted, scoring.encoders(table, levels, labeller))
    return raw, labelled, fitted, levels, models.load_bundle(spark, path)


KEY = list(KEYS)


def test_stored_and_session_scores_agree(trained):
    raw, labelled, fitted, levels, bundle = trained
    stored = {tuple(r[k] for k in KEY): r for r in scoring.score_orders(raw, bundle.models, bundle.tables).collect()}
    coded, _, _ = classify.late_inputs(labelled, levels)
    own = classify.predict_probability(fitted["late"], coded, "p", flag=None).select(*KEY, F.bround("p", 4).alias("p")).collect()
    assert len(stored) == len(own) and all(stored[tuple(r[:4])]["p_late"] == r["p"] for r in own)


def test_new_orders_without_labels(trained):
    """One order alone, without label and delivery, of unknown region, mode and segment, is scored; company changes nothing."""
    raw, _, _, _, bundle = trained
    some = raw.orderBy(*KEY).limit(5)
    unlabelled = some.drop("late_risk", "order_status")
    strange = unlabelled.withColumns({"order_region": F.lit("Atlantis"), "shipping_mode": F.lit("Balloon"), "customer_segment": F.lit(None).cast("string")})
    for given in (unlabelled, strange):
        scored = scoring.score_orders(given, bundle.models, bundle.tables).orderBy(*KEY).collect()
        assert len(scored) == 5 and all(0 <= r[p] <= 1 for r in scored for p in ("p_late", "p_fraud", "p_cancel"))
        alone = scoring.score_orders(given.orderBy(*KEY).limit(1), bundle.models, bundle.tables).first()
        assert alone == scored[0]
    assert scoring.score_orders(unlabelled.limit(0), bundle.models, bundle.tables).count() == 0


def test_all_file_columns_are_read(spark, tmp_path):
    header = ",".join(f'" {c}"' if i % 2 else c for i, c in enumerate(CSV_COLUMNS))
    values = ["1/31/2018 22:56" if "date" in c else "7" for c in CSV_COLUMNS]
    (tmp_path / "orders.csv").write_text(header + ",Other\n" + ",".join(values) + ",x\n", encoding="latin-1")
    row = load_orders_csv(spark, str(tmp_path / "orders.csv")).first().asDict()
    assert len(row) == len(CSV_COLUMNS) == 53 and len(set(row)) == 53
    assert row["order_state"] == "7" and row["product_id"] == 7 and row["order_date"].year == 2018
