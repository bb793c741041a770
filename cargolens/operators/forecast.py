"""Demand forecasting on the daily panel: boosted trees, ensembles, stacking.

Models of all regions, or of all folds, are fitted in one job (``trees.fit`` with a key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import trees as T
from cargolens.operators.panel import REGION
from cargolens.operators.scale import hash_share
from cargolens.operators.trees import Ensemble, Plan
from cargolens.operators.verify import regression_metrics

# Share of the regional model in the ensemble, ridge penalty of the stack.
REGIONAL_SHARE = 0.7
RIDGE_ALPHA = 1.0

# Size of the boosted ensembles.
GLOBAL_TREES, GLOBAL_DEPTH = 200, 6
REGIONAL_TREES, REGIONAL_DEPTH = 150, 5
LEARNING_RATE, ROW_SHARE, COLUMN_SHARE = 0.05, 0.8, 0.8
MIN_REGION_ROWS, MIN_TRAIN_ROWS, MIN_TEST_ROWS = 60, 20, 10


def boosted_plan(trees: int, depth: int, rate: float = LEARNING_RATE) -> Plan:
    return Plan("squared", trees, depth, rate, ROW_SHARE, COLUMN_SHARE)


def predict(model: Ensemble, df: DataFrame, alias: str = "prediction") -> DataFrame:
    return df.withColumn(alias, model.score())


def fit_global(rows: DataFrame, features: Sequence[str], trees: int = GLOBAL_TREES, depth: int = GLOBAL_DEPTH) -> Ensemble:
    """One model over all regions, from the rows marked as training rows. All of them teach."""
    return T.fit(rows.where("is_train = 1"), features, boosted_plan(trees, depth), "sales")


def eligible_regions(split: DataFrame) -> DataFrame:
    """Regions with enough rows for a model of their own."""
    sizes = split.groupBy(REGION).agg(F.max("region_rows").alias("n"), F.max("region_train_rows").alias("t"))
    fit = (F.col("n") >= MIN_REGION_ROWS) & (F.col("t") >= MIN_TRAIN_ROWS) & (F.col("n") - F.col("t") >= MIN_TEST_ROWS)
    return sizes.where(fit).select(REGION)


def fit_regional(rows: DataFrame, features: Sequence[str], trees: int = REGIONAL_TREES, depth: int = REGIONAL_DEPTH) -> Ensemble:
    """One model per region with enough rows, all in one job. ``rows`` has the regional split."""
    train = rows.where("is_train = 1").join(eligible_regions(rows), REGION, "left_semi")
    return T.fit(train, features, boosted_plan(trees, depth), "sales", F.col(REGION))


def predict_regional(models: Ensemble, df: DataFrame, alias: str = "regional_prediction") -> DataFrame:
    """Prediction of the row's own region; null where the region has no model."""
    return df.withColumn(alias, models.score(key=F.col(REGION)))


def regional_performance(models: Ensemble, split: DataFrame) -> DataFrame:
    """Errors on each region's own test rows, with its row counts."""
    scored = predict_regional(models, split.where("is_train = 0")).where("regional_prediction is not null")
    errors = regression_metrics(scored, "sales", "regional_prediction", [REGION])
    sizes = split.groupBy(REGION).agg(F.max("region_rows").alias("samples"), F.max("region_train_rows").alias("train"))
    return errors.join(sizes, REGION).select(
        F.col(REGION).alias("region"), "mae", "rmse", "r2", "samples", "train", F.col("n").alias("test"))


def evaluate_ensemble(global_model: Ensemble, models: Ensemble, rows: DataFrame) -> DataFrame:
    """Both predictions and their blend on the test rows of the global split."""
    test = predict(global_model, rows.where("is_train = 0"), "global_prediction")
    return ensemble_forecast(predict_regional(models, test))


def predict_all_regions(global_model: Ensemble, models: Ensemble, rows: DataFrame) -> DataFrame:
    """Every row scored once for every region that has a model, in one pass over the rows."""
    base = predict(global_model, rows, "global_prediction").drop(REGION)
    regions = models.nodes.select("key").distinct().agg(F.sort_array(F.collect_list("key")).alias("k"))  # as many as there are models
    asked = base.withColumn(REGION, F.explode(regions.scalar()))
    return ensemble_forecast(predict_regional(models, asked))


def oof_predictions(rows: DataFrame, features: Sequence[str], folds: int = 5, trees: int = GLOBAL_TREES,
                    depth: int = GLOBAL_DEPTH) -> DataFrame:
    """Each row predicted by a model that never saw it; folds by row hash, their models fitted together."""
    marked = rows.withColumn("fold", F.floor(hash_share(rows) * folds).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    models = T.fit(marked.withColumn("_model", F.explode(others)), features, boosted_plan(trees, depth), "sales", F.col("_model"))
    return marked.withColumn("prediction", models.score(key=F.col("fold")))


def importance(model: Ensemble, features: Sequence[str] | None = None) -> DataFrame:
    """Share of every feature in the gains of all splits, largest first (one row per feature)."""
    return model.importance()


def cv_forecast(folded: DataFrame, features: Sequence[str], folds: int = 5, trees: int = GLOBAL_TREES,
                depth: int = GLOBAL_DEPTH) -> DataFrame:
    """Walk-forward validation: fold f trains on all rows before its test block. One row per fold, one fit for all."""
    size = F.floor(F.col("rows_total") / (folds + 1))
    first = F.col("rows_total") - size * folds
    later = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: F.col("row_index") < first + size * (f - 1))
    models = T.fit(folded.withColumn("_model", F.explode(later)), features, boosted_plan(trees, depth), "sales", F.col("_model"))
    out = folded.where("test_fold IS NOT NULL").withColumn("prediction", models.score(key=F.col("test_fold")))
    return regression_metrics(out, "sales", "prediction", ["test_fold"]).withColumnRenamed("test_fold", "fold")


def summarise_folds(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    rows = folds.unpivot([], list(metrics), "metric", "value")
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))



def ensemble_forecast(preds: DataFrame, share: float = REGIONAL_SHARE) -> DataFrame:
    """Blend of regional and global prediction; the global one alone where a region has no model."""
    g, r = F.col("global_prediction"), F.col("regional_prediction")
    return preds.withColumn("prediction", F.when(r.isNull(), g).otherwise(share * r + (1 - share) * g))


def model_comparison(global_metrics: DataFrame, regional_perf: DataFrame, ensemble_metrics: DataFrame) -> DataFrame:
    """Global, mean regional and ensemble errors, with the gain in MAE over the global model."""
    names = ("mae", "rmse", "r2")
    average = regional_perf.agg(*[F.avg(c).alias(c) for c in names])
    parts = (("Global", global_metrics), ("Regional (Avg)", average), ("Ensemble", ensemble_metrics))
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("model"), *names)
        out = row if out is None else out.unionByName(row)
    base = global_metrics.select("mae").scalar()
    return out.withColumn("mae_gain_pct", X.ratio(base - F.col("mae"), base) * 100)


def ridge_weights(preds: DataFrame, a: str, b: str, y: str, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Ridge weights of two base predictions from one pass of centred sums; the intercept is free."""
    n = F.count(F.lit(1))
    s = preds.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).agg(
        (F.var_pop(a) * n + alpha).alias("aa"), (F.var_pop(b) * n + alpha).alias("bb"),
        (F.covar_pop(a, b) * n).alias("ab"), (F.covar_pop(a, y) * n).alias("ay"), (F.covar_pop(b, y) * n).alias("by"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    wa = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det
    wb = (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    return s.select(wa.alias("weight_a"), wb.alias("weight_b"),
                    (F.col("my") - wa * F.col("ma") - wb * F.col("mb")).alias("intercept"))


def stack_comparison(preds: DataFrame, a: str, b: str, y: str, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Errors of either base prediction and of their ridge stack."""
    w = ridge_weights(preds, a, b, y, alpha).select(F.struct("*").alias("w")).scalar()
    stacked = preds.withColumn(
        "_stack", w.getField("intercept") + w.getField("weight_a") * F.col(a) + w.getField("weight_b") * F.col(b))
    out = None
    for name, column in ((f"{a} only", a), (f"{b} only", b), ("stacked", "_stack")):
        row = regression_metrics(stacked, y, column).select(F.lit(name).alias("model"), "mae", "rmse", "r2")
        out = row if out is None else out.unionByName(row)
    return out
