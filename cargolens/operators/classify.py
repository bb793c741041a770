"""Late-delivery, fraud and cancellation classifiers, and their verification fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import trees as T
from cargolens.operators.features import add_codes, level_codes, one_hot_drop_first
from cargolens.operators.risk import map_cancel_rate
from cargolens.operators.scale import add_rank_share, attach, numbered, permuted, row_index, stratified_folds
from cargolens.operators.trees import Ensemble, Plan
from cargolens.operators.verify import confusion, ranking_scores, regression_metrics
from cargolens.session import cut

REGION = "macro_region"

# Model inputs and sizes.
LATE_NUMERIC = [
    "days_scheduled", "order_item_total", "sales", "quantity", "discount_rate", "benefit", "shipping_distance_km",
    "weather_risk", "region_late_rate", "region_avg_order_value", "region_avg_days", "order_month", "order_dayofweek",
    "is_weekend", "holiday_flag", "is_cross_border", "kmeans_cluster",
]
LATE_CATEGORIES = ["shipping_mode", "season", "customer_segment", REGION]
FRAUD_NUMERIC = ["discount_rate", "product_price", "profit_ratio", "benefit", "quantity", "sales_per_customer",
                 "days_real", "days_scheduled"]
FRAUD_CATEGORIES = ["customer_segment", "order_region", "market", "shipping_mode"]
CANCEL_NUMERIC = ["product_status", "profit_ratio", "discount_rate", "product_price", "quantity",
                  "regional_cancel_rate", "days_scheduled"]
CANCEL_CATEGORIES = ["shipping_mode", "customer_segment", "market"]
FOREST_TREES, FOREST_DEPTH = 200, 10
REGIONAL_FOREST_TREES, REGIONAL_FOREST_DEPTH = 150, 8
FRAUD_TREES, FRAUD_DEPTH = 500, 6
CANCEL_TREES, CANCEL_DEPTH = 300, 5
BOOST_RATE = 0.05
TRAIN_SHARE = 0.8
MIN_REGION_ROWS, MIN_CLASS_ROWS = 100, 20


# --- Late delivery -----------------------------------------------------------------------


def late_inputs(df: DataFrame, levels: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str], dict]:
    """Numeric inputs that exist plus 0/1 columns per category level (first level dropped)."""
    numeric = [c for c in LATE_NUMERIC if c in df.columns]
    categories = [c for c in LATE_CATEGORIES if c in df.columns]
    # Rows without a label can't teach, but with the levels of a fitted model they are coded and scored.
    known = df.where(F.col("late_risk").isNotNull()) if levels is None else df
    coded, dummies, levels = one_hot_drop_first(known, categories, levels)
    if "late_risk" in df.columns:
        coded = coded.withColumn("label", F.col("late_risk").cast("int"))
    return coded, [*numeric, *dummies], levels


def stratified_split(df: DataFrame, strata: Sequence[str] = ("label",), train: float = TRAIN_SHARE, seed: int = 42) -> DataFrame:
    """Mark the given share of every class as training rows, by hash rank."""
    return add_rank_share(df, strata, seed).withColumn("is_train", (F.col("_share") < train).cast("int")).drop("_share")


def forest(trees: int, depth: int) -> Plan:
    return Plan("forest", trees, depth)


def boosted(trees: int, depth: int) -> Plan:
    return Plan("logistic", trees, depth, BOOST_RATE)


def predict_probability(model: Ensemble, df: DataFrame, alias: str = "score", cut_at: float = 0.5, flag: str | None = "predicted",
                        key: Column | None = None) -> DataFrame:
    """Probability of the positive class on every row; with a key, by the model of the row's key."""
    out = df.withColumn(alias, model.score(key=key))
    return out if flag is None else out.withColumn(flag, (F.col(alias) >= cut_at).cast("int"))


def fit_late(rows: DataFrame, features: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> Ensemble:
    return T.fit(rows.where("is_train = 1"), features, forest(trees, depth), "label")


def classifier_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, area under the ROC curve and average precision."""
    counts = confusion(scored, by=by)
    ranks = ranking_scores(scored, by=by)
    joined = counts.join(ranks, list(by)) if by else counts.withColumn("_one", F.lit(1)).join(
        ranks.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.select(*by, "precision", "recall", "f1", "auc", "avg_precision")


def late_regions(rows: DataFrame) -> DataFrame:
    """Regions with enough rows of both classes for a forest of their own."""
    sizes = rows.groupBy(REGION).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("late"))
    fit = (F.col("n") >= MIN_REGION_ROWS) & (F.col("late") >= MIN_CLASS_ROWS) & (F.col("n") - F.col("late") >= MIN_CLASS_ROWS)
    return sizes.where(fit).select(REGION)


def fit_late_regional(rows: DataFrame, features: Sequence[str], trees: int = REGIONAL_FOREST_TREES,
                      depth: int = REGIONAL_FOREST_DEPTH) -> Ensemble:
    """A forest per region with enough rows of both classes, all in one job; ``rows`` is split inside (region, class)."""
    train = rows.where("is_train = 1").join(late_regions(rows), REGION, "left_semi")
    return T.fit(train, features, forest(trees, depth), "label", F.col(REGION))


def late_regional_performance(models: Ensemble, rows: DataFrame) -> DataFrame:
    """Scores of every region's model on its own test rows."""
    scored = predict_probability(models, rows.where("is_train = 0"), key=F.col(REGION)).where("score IS NOT NULL")
    sizes = rows.groupBy(REGION).agg(F.count(F.lit(1)).alias("samples"), F.sum("label").alias("late_count"))
    return classifier_metrics(scored.select(REGION, "label", "score", "predicted"), [REGION]).join(sizes, REGION)


def predict_late(global_model: Ensemble, models: Ensemble, df: DataFrame) -> DataFrame:
    """Probability from the row's regional model if there is one, else from the global model."""
    both = df.withColumn("score", F.coalesce(models.score(key=F.col(REGION)), global_model.score()))
    return both.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# --- Fraud and cancellation --------------------------------------------------------------


def fraud_inputs(df: DataFrame, codes: DataFrame | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    codes = level_codes(df, FRAUD_CATEGORIES) if codes is None else codes
    coded = add_codes(df, FRAUD_CATEGORIES, codes).withColumn("label", X.fraud_flag())
    return coded, [*FRAUD_NUMERIC, *[f"{c}_code" for c in FRAUD_CATEGORIES]], codes


def balanced_weights(df: DataFrame, by: Sequence[str] = (), alias: str = "_w") -> DataFrame:
    """Weight each class by the size of the larger one over its own, in each group ``by``."""
    p, q = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    if by:
        df = attach(df, df.groupBy(*by).agg(p.alias("_p"), q.alias("_q")), list(by), "inner")
    else:
        df = df.crossJoin(F.broadcast(df.agg(p.alias("_p"), q.alias("_q"))))  # one row
    top = F.greatest("_p", "_q")
    return df.withColumn(alias, F.when(F.col("label") == 1, top / F.greatest("_p", F.lit(1))).otherwise(top / F.greatest("_q", F.lit(1)))).drop("_p", "_q")


def fit_fraud(df: DataFrame, features: Sequence[str], trees: int = FRAUD_TREES, depth: int = FRAUD_DEPTH) -> Ensemble:
    """Boosted trees on balanced classes."""
    return T.fit(balanced_weights(df), features, boosted(trees, depth), "label", weight=F.col("_w"))


def other_folds(marked: DataFrame, folds: int, alias: str = "_model") -> DataFrame:
    """Every row once for each fold it teaches the model of: all folds but its own."""
    return marked.withColumn(alias, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))))


def fraud_cv_auc(df: DataFrame, features: Sequence[str], folds: int = 5, trees: int = FRAUD_TREES, depth: int = FRAUD_DEPTH) -> DataFrame:
    """Area under the ROC curve per stratified fold; the models of all folds are fitted in one job."""
    marked = cut(stratified_folds(df, ["label"], folds))
    train = balanced_weights(other_folds(marked, folds), ["_model"])
    models = T.fit(train, features, boosted(trees, depth), "label", F.col("_model"), F.col("_w"))
    scored = predict_probability(models, marked, key=F.col("fold")).select("fold", "label", "score")
    return ranking_scores(scored, by=["fold"]).select("fold", "auc")


def fraud_score(model: Ensemble, df: DataFrame) -> DataFrame:
    out = predict_probability(model, df, "fraud_probability", flag="fraud_flag")
    edges, labels = X.FRAUD_TIERS
    return out.withColumn("fraud_risk_tier", X.cut_tiers("fraud_probability", edges, labels, include_lowest=False))


def cancel_inputs(df: DataFrame, rates: DataFrame | None = None, codes: DataFrame | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    codes = level_codes(df, CANCEL_CATEGORIES) if codes is None else codes
    coded = add_codes(map_cancel_rate(df, rates), CANCEL_CATEGORIES, codes).withColumn("label", X.cancel_flag())
    return coded, [*CANCEL_NUMERIC, *[f"{c}_code" for c in CANCEL_CATEGORIES]], codes


def fit_cancel(rows: DataFrame, features: Sequence[str], trees: int = CANCEL_TREES, depth: int = CANCEL_DEPTH) -> Ensemble:
    """Boosted trees with the positive class weighted by (1 - p) / p of the training rows."""
    train = rows.where("is_train = 1")
    p = train.agg(F.avg("label")).scalar()
    weight = F.when(F.col("label") == 1, (1 - p) / p).otherwise(F.lit(1.0))
    return T.fit(train.withColumn("_w", weight), features, boosted(trees, depth), "label", weight=F.col("_w"))


def cancel_score(model: Ensemble, df: DataFrame) -> DataFrame:
    return predict_probability(model, df, "cancellation_probability", flag="cancellation_flag")


# --- Verification fits -------------------------------------------------------------------


def cv_classifier(rows: DataFrame, features: Sequence[str], folds: int = 5, trees: int = 100, depth: int = 8) -> DataFrame:
    """Stratified folds: F1, area under the ROC curve, average precision per fold; one fit for all."""
    marked = cut(stratified_folds(rows, ["label"], folds))
    models = T.fit(other_folds(marked, folds), features, forest(trees, depth), "label", F.col("_model"))
    scored = predict_probability(models, marked, key=F.col("fold")).select("fold", "label", "score", "predicted")
    return classifier_metrics(scored, ["fold"]).select("fold", "f1", "auc", "avg_precision")


def learning_curve(rows: DataFrame, features: Sequence[str], plan: Plan, task: str, folds: int = 3,
                   max_samples: int | None = None, steps: int = 8, target: str = "label") -> DataFrame:
    """Train and validation score for growing shares of the training rows, of all rows unless the caller bounds them by ``max_samples``.

    The models of all folds and shares are fitted in one job. ``task`` is 'regression' (R2) or 'classification' (F1).
    """
    indexed = row_index(rows)
    if max_samples is not None:
        indexed = indexed.where(F.col("_index") < max_samples)
    sample = cut(indexed.withColumn("fold", (F.col("_index") % folds).cast("int")).drop("_index", "_index_size"))
    sample = cut(add_rank_share(sample, ["fold"], seed=7, alias="_share"))
    shares = F.array(*[F.lit(0.1 + 0.9 * i / (steps - 1)) for i in range(steps)])
    each = sample.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))) \
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))) \
        .withColumn("split", F.when(F.col("fold") == F.col("_fold"), "validation").otherwise("train")) \
        .where((F.col("split") == "validation") | (F.col("_share") < F.get(shares, F.col("step"))))
    model = F.col("_fold") * steps + F.col("step")
    models = T.fit(each.where("split = 'train'"), features, plan, target, model)
    value = models.score(key=model)
    scored = each.select(F.col("_fold").alias("fold"), "step", "split", F.col(target).alias("y"),
                         (value if task == "regression" else (value >= 0.5).cast("double")).alias("prediction"))
    keys = ["fold", "step", "split"]
    if task == "regression":
        scores = regression_metrics(scored, by=keys).select(*keys, F.col("r2").alias("score"))
    else:
        scores = confusion(scored, "y", "prediction", keys).select(*keys, F.col("f1").alias("score"))
    sizes = sample.groupBy("fold").count().agg(F.sum("count") - F.max("count")).scalar()
    out = scores.groupBy("step").agg(
        F.avg(F.when(F.col("split") == "train", F.col("score"))).alias("train_mean"),
        F.stddev_pop(F.when(F.col("split") == "train", F.col("score"))).alias("train_std"),
        F.avg(F.when(F.col("split") == "validation", F.col("score"))).alias("validation_mean"),
        F.stddev_pop(F.when(F.col("split") == "validation", F.col("score"))).alias("validation_std"),
    )
    share = F.get(shares, F.col("step"))
    gap = F.col("train_mean") - F.col("validation_mean")
    verdict = F.when(gap > 0.15, "HIGH VARIANCE").when(F.col("validation_mean") < 0.6, "HIGH BIAS").otherwise("GOOD FIT")
    return out.withColumn("train_rows", F.floor(share * sizes)).withColumn("verdict", verdict).orderBy("step")


def permutation_importance(model: Ensemble, rows: DataFrame, features: Sequence[str], task: str, repeats: int = 10,
                           target: str = "label", seed: int = 42) -> DataFrame:
    """Drop of the score when one column is dealt out to other rows.

    Rows get their numbers once; repeat r hands row i the values of the row at place i of the r-th random order.
    That is one join per repeat for all columns together, and one model pass for everything.
    """
    base = rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.col(target).cast("double").alias("_y"))
    dealt = cut(numbered(base, seed))
    asks = dealt.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) \
        .withColumn("_from", permuted(F.col("_index"), F.col("_index_size"), F.col("_repeat") + seed))
    other = dealt.select(F.col("_index").alias("_from"), F.col("_x").alias("_o"))
    pairs = asks.join(other, "_from")
    # Variant -1 of repeat 1 is the untouched row; variant j takes column j from the other row.
    variants = F.sequence(F.when(F.col("_repeat") == 1, -1).otherwise(0), F.lit(len(features) - 1))
    each = pairs.withColumn("_variant", F.explode(variants))
    mixed = F.transform("_x", lambda v, j: F.when(j == F.col("_variant"), F.element_at("_o", j + 1)).otherwise(v))
    value = model.score(mixed)
    scored = each.select("_repeat", "_variant", F.col("_y").alias("y"), (value if task == "regression" else (value >= 0.5).cast("double")).alias("prediction"))
    keys = ["_repeat", "_variant"]
    if task == "regression":
        scores = regression_metrics(scored, by=keys).select(*keys, F.col("r2").alias("score"))
    else:
        scores = weighted_f1(scored, keys)
    plain = scores.where("_variant = -1").agg(F.max("score")).scalar()
    names = X.lookup("_variant", {i: f for i, f in enumerate(features)})
    drop = plain - F.col("score")
    return scores.where("_variant >= 0").withColumn("feature", names).groupBy("feature").agg(
        F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("std_drop")).orderBy(F.desc("mean_drop"), "feature")


def weighted_f1(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """F1 of both classes weighted by their rows."""
    c = confusion(scored, "y", "prediction", by)
    zero = F.lit(0.0)
    f_neg = F.coalesce(X.ratio(2.0 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")), zero)
    neg, pos = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    return c.select(*by, ((F.col("f1") * pos + f_neg * neg) / (pos + neg)).alias("score"))
