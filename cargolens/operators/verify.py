"""Model verification from scored rows: metrics, curves, calibration, verdicts.

Curves group by score first and use bucketed running totals, so tied scores are exact and no
task sorts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators.scale import running_totals
from cargolens.operators.stats import histogram


def regression_metrics(scored: DataFrame, actual: str = "y", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and MAPE in one pass; MAPE skips actuals near zero."""
    y = F.col(actual).cast("double")
    e = y - F.col(predicted)
    n = F.count(e)
    spread = F.var_pop(F.when(e.isNotNull(), y)) * n
    return scored.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - X.ratio(F.sum(e * e), spread)).alias("r2"),
        (F.avg(F.when(F.abs(y) > 1e-8, F.abs(e / y))) * 100).alias("mape"),
    )


def confusion(scored: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Counts and precision, recall, F1 of the positive class; 0 where a ratio is undefined."""
    y, p = F.col(label), F.col(predicted)
    counts = scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(X.ratio("tp", F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(X.ratio("tp", F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(X.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def class_report(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    one = confusion(scored, label, predicted)
    rows = [
        F.struct(F.lit(k).alias("class"), F.col(hit).alias("_hit"), (F.col(hit) + F.col(wrong)).alias("_said"),
                 (F.col(hit) + F.col(missed)).alias("support"))
        for k, hit, wrong, missed in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn"))
    ]
    zero = F.lit(0.0)
    return one.select(F.inline(F.array(*rows))).select(
        "class", F.coalesce(X.ratio("_hit", "_said"), zero).alias("precision"),
        F.coalesce(X.ratio("_hit", "support"), zero).alias("recall"),
        F.coalesce(X.ratio(2.0 * F.col("_hit"), F.col("_said") + F.col("support")), zero).alias("f1"), "support",
    )


def score_counts(scored: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _from_the_top(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group and) distinct score with the counts at or above it."""
    ranked = running_totals(score_counts(scored, score, label, by), "threshold", {"p": "pos", "q": "neg"}, by, descending=True)
    return ranked.select(
        *by, "threshold", "pos", "neg", (F.col("p_before") + F.col("p_ties")).alias("tp"),
        (F.col("q_before") + F.col("q_ties")).alias("fp"), F.col("p_before").alias("tp_above"),
        F.col("p_all").alias("all_pos"), F.col("q_all").alias("all_neg"),
    )


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score; the start point (0, 0) is implied."""
    return _from_the_top(scored, score, label).select(
        "threshold", X.ratio("fp", "all_neg").alias("fpr"), X.ratio("tp", "all_pos").alias("tpr"))


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    t = _from_the_top(scored, score, label)
    return t.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    X.ratio("tp", "all_pos").alias("recall"))


def ranking_scores(scored: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (trapezoids over ties) and average precision; null for one class only."""
    t = _from_the_top(scored, score, label, by)
    area = F.sum(F.col("neg") * (F.col("tp_above") + F.col("pos") / 2))
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return t.groupBy(*by).agg(
        X.ratio(area, F.max("all_pos") * F.max("all_neg")).alias("auc"),
        X.ratio(steps, F.max("all_pos")).alias("avg_precision"),
    )


def best_f1_threshold(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Score with the best F1; the smallest of equals."""
    curve = pr_curve(scored, score, label)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    return curve.withColumn("f1", f1).agg(
        F.min_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")
    ).select("b.*")


def calibration(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Observed share and mean score per uniform bin; empty bins are left out."""
    known = scored.where(F.col(score).isNotNull())
    return known.groupBy(X.bin_index(score, 0.0, 1.0, bins).alias("bin")).agg(
        F.avg(label).alias("observed"), F.avg(score).alias("predicted"), F.count(F.lit(1)).alias("count"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Unweighted mean gap over the bins."""
    return bins.agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("calibration_error"))


def score_distribution(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 50) -> DataFrame:
    return histogram(scored, score, bins, [label], 0.0, 1.0).select(label, "bin", "count")


def overfit_check(metrics: DataFrame, task: str = "regression") -> DataFrame:
    """Train minus test gap of the leading metric and its verdict. ``metrics`` has one row per split."""
    lead = "r2" if task == "regression" else "f1"
    names = [c for c in metrics.columns if c != "split"]
    wide = metrics.groupBy().agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "test") for c in names
    ])
    gap = F.col(f"train_{lead}") - F.col(f"test_{lead}")
    if task == "regression":
        verdict = F.when(gap > 0.15, "OVERFITTING").when(gap < 0.02, "OK").otherwise("MILD")
    else:
        verdict = F.when(gap > 0.05, "OVERFITTING").otherwise("OK")
    return wide.withColumn("gap", gap).withColumn("verdict", verdict)


def efficiency_verdict(forecast_r2, classifier_f1, cv_r2_std, base: DataFrame) -> DataFrame:
    """Verdict per part of the suite from columns of a one-row metrics table."""
    r2, f1, std = F.col(forecast_r2), F.col(classifier_f1), F.col(cv_r2_std)
    rows = [
        F.struct(F.lit("forecast").alias("part"), r2.alias("value"),
                 F.when(r2 > 0.8, "STRONG").when(r2 > 0.6, "MODERATE").otherwise("NEEDS IMPROVEMENT").alias("verdict")),
        F.struct(F.lit("classifier").alias("part"), f1.alias("value"),
                 F.when(f1 > 0.9, "STRONG").when(f1 > 0.75, "MODERATE").otherwise("NEEDS IMPROVEMENT").alias("verdict")),
        F.struct(F.lit("forecast_cv").alias("part"), std.alias("value"),
                 F.when(std < 0.05, "STABLE").otherwise("VARIABLE").alias("verdict")),
    ]
    return base.select(F.inline(F.array(*rows)))
