"""Treatment effects by matching, regression and weighting; refutations; what-if scenarios.

Everything works on cells: rows with equal covariates are counted once per arm. The tables behind
the propensity fit, the matching and the bootstrap then grow with the covariate combinations, not
with the orders.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.functions import columns as X
from cargolens.operators.classify import late_inputs, predict_probability
from cargolens.operators.clean import override_columns, query_filter
from cargolens.operators.features import add_label_codes, add_planar_distance
from cargolens.operators.scale import BUCKET, exact_quantiles, numbered, permuted, with_buckets
from cargolens.operators.trees import Ensemble
from cargolens.session import cut

# Fixed value: discounts above this share count as high.
HIGH_DISCOUNT = 0.20
LATE_COVARIATES = ["order_region_code", "market_code", "planar_distance_km", "customer_segment_code"]
FRAUD_COVARIATES = ["order_region_code", "customer_segment_code"]


def causal_prepare(df: DataFrame) -> DataFrame:
    """Binary treatment (fast shipping) and outcome, coded confounders, planar distance."""
    coded = add_label_codes(add_planar_distance(df), ["order_region", "market", "customer_segment"])
    return coded.withColumn("treated", F.col("shipping_mode").isin(*X.FAST_MODES).cast("int")) \
        .withColumn("outcome", F.col("late_risk").cast("int"))


def fraud_prepare(df: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    coded = add_label_codes(df, ["order_region", "customer_segment"])
    return coded.withColumn("treated", (F.col("discount_rate") > threshold).cast("int")).withColumn("outcome", X.fraud_flag())


def cells(rows: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """One row per covariate combination: sizes and outcome sums of both arms."""
    arm = lambda k, c: F.sum(F.when(F.col("treated") == k, c).otherwise(0))
    return rows.groupBy(*covariates).agg(
        arm(1, F.lit(1)).alias("n1"), arm(1, F.col("outcome")).alias("y1"),
        arm(0, F.lit(1)).alias("n0"), arm(0, F.col("outcome")).alias("y0"))


def add_propensity(table: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Chance of treatment per cell, from a logistic regression weighted with the cell sizes."""
    vectors = VectorAssembler(inputCols=list(covariates), outputCol="_v").transform(table)
    arms = F.array(F.struct(F.lit(1.0).alias("t"), F.col("n1").alias("w")), F.struct(F.lit(0.0).alias("t"), F.col("n0").alias("w")))
    train = vectors.select("_v", F.inline(arms)).where("w > 0").withColumn("w", F.col("w").cast("double"))
    model = LogisticRegression(featuresCol="_v", labelCol="t", weightCol="w", maxIter=100, tol=1e-10,
                               probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q").fit(train)
    return model.transform(vectors).withColumn("score", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_q")


def nearest_score_match(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean outcome of the other arm at the nearest score, for both arms of every distinct score.

    ``table`` has score, n1, y1, n0, y0. Scores are cut into ordered buckets; the last known arm below
    and the first above a bucket are carried in from its neighbours, so no task sees all scores.
    Equal distances take the lower score; equal scores share their mean.
    """
    one = table.groupBy(*by, "score").agg(*[F.sum(c).alias(c) for c in ("n1", "y1", "n0", "y0")])
    marks = {k: F.when(F.col(f"n{k}") > 0, F.struct(F.col("score").alias("s"), (F.col(f"y{k}") / F.col(f"n{k}")).alias("m"))) for k in (0, 1)}
    t = with_buckets(one, "score").withColumns({f"c{k}": m for k, m in marks.items()})
    keys = [*by, BUCKET]
    ends = t.groupBy(*keys).agg(*[f(F.col(f"c{k}")).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.min, "first"), (F.max, "last"))])
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(BUCKET)  # one row per bucket
    carried = ends.select(
        *keys, *[F.max(f"last{k}").over(over.rowsBetween(W.unboundedPreceding, -1)).alias(f"below{k}") for k in (0, 1)],
        *[F.min(f"first{k}").over(over.rowsBetween(1, W.unboundedFollowing)).alias(f"above{k}") for k in (0, 1)])
    # Looking ahead is looking back in descending order: a frame that ends at the last row would be summed anew per row.
    upto = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    downto = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    local = t.select(
        "*", *[F.max(f"c{k}").over(upto).alias(f"lo{k}") for k in (0, 1)],
        *[F.min(f"c{k}").over(downto).alias(f"hi{k}") for k in (0, 1)])
    joined = local.join(carried, keys)

    def matched(k: int) -> Column:
        lo, hi = F.coalesce(f"lo{k}", f"below{k}"), F.coalesce(f"hi{k}", f"above{k}")
        nearer = F.when(hi.isNull(), lo).when(lo.isNull(), hi).when(
            F.col("score") - lo["s"] <= hi["s"] - F.col("score"), lo).otherwise(hi)
        return nearer["m"]

    return joined.select(*by, "score", "n1", "y1", "n0", "y0", matched(0).alias("m0"), matched(1).alias("m1"))


def match_ate(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gain = (F.col("y1") - F.col("n1") * F.col("m0")) + (F.col("n0") * F.col("m1") - F.col("y0"))
    return matched.groupBy(*by).agg((F.sum(gain) / F.sum(F.col("n1") + F.col("n0"))).alias("ate"),
                                    F.sum(F.col("n1") + F.col("n0")).alias("n"))


def ate_psm(rows: DataFrame, covariates: Sequence[str] = LATE_COVARIATES) -> DataFrame:
    """Average effect by nearest propensity score, matched both ways."""
    table = cut(add_propensity(cut(cells(rows, covariates)), covariates))
    return match_ate(nearest_score_match(table))


def ate_ipw(scored: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Inverse-propensity weighting; scores are kept within [low, high]."""
    e = F.least(F.greatest(F.col("score"), F.lit(low)), F.lit(high))
    n = F.sum(F.col("n1") + F.col("n0"))
    return scored.agg(((F.sum(F.col("y1") / e) - F.sum(F.col("y0") / (1 - e))) / n).alias("ate"), n.alias("n"))


_SOLUTION = T.StructType([T.StructField("ate", T.DoubleType()), T.StructField("std_error", T.DoubleType())])


@F.pandas_udf(_SOLUTION)
def _first_coefficient(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Coefficient of the first regressor and its standard error, from centred sums of products."""
    out = []
    for a, b, c, m in zip(xx, xy, yy, n):
        b = np.asarray(b, float)
        a = np.asarray(a, float).reshape(len(b), len(b))
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        rest = max(c - beta @ b, 0.0) / (m - len(b) - 1)
        out.append((beta[0], float(np.sqrt(rest * inverse[0, 0]))))
    return pd.DataFrame(out, columns=["ate", "std_error"])


def ate_linear(rows: DataFrame, covariates: Sequence[str] = LATE_COVARIATES) -> DataFrame:
    """Treatment coefficient of a least-squares fit with the covariates, with a 95 % interval."""
    names = ["treated", *covariates]
    grouped = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("w"), F.sum("outcome").alias("sy"),
                                       F.sum(F.col("outcome") * F.col("outcome")).alias("syy"))
    grouped = cut(grouped)
    w = F.col("w")
    mean = grouped.agg(F.struct((F.sum("sy") / F.sum(w)).alias("_y"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in names]).alias("m")).scalar()
    d = {c: F.col(c) - mean.getField(c) for c in names}
    dy = F.col("sy") - w * mean.getField("_y")
    centred = grouped.select("w", "sy", "syy", dy.alias("dy"), *[v.alias(f"d_{c}") for c, v in d.items()])
    sums = centred.agg(
        F.array(*[F.sum(w * F.col(f"d_{a}") * F.col(f"d_{b}")) for a in names for b in names]).alias("xx"),
        F.array(*[F.sum(F.col(f"d_{a}") * F.col("dy")) for a in names]).alias("xy"),
        (F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("w")).alias("yy"), F.sum("w").cast("double").alias("n"))
    out = sums.select(_first_coefficient("xx", "xy", "yy", "n").alias("s"), F.col("n").cast("bigint").alias("n"))
    reach = 1.959963984540054 * F.col("s.std_error")
    return out.select("s.ate", "s.std_error", (F.col("s.ate") - reach).alias("ci_low"), (F.col("s.ate") + reach).alias("ci_high"), "n")


def refute_placebo(rows: DataFrame, covariates: Sequence[str] = LATE_COVARIATES, seed: int = 42) -> DataFrame:
    """Effect of a treatment dealt out to other rows at random; should be near 0.

    Row i of the numbered rows is given the treatment of the row at place i of a random order. Numbers follow the rows'
    values, so the deal does not depend on files or partitions.
    """
    own = cut(numbered(rows.select("treated", "outcome", *covariates), seed))
    given = own.select(permuted(F.col("_index"), F.col("_index_size"), F.lit(seed)).alias("_index"), "treated")
    return ate_psm(own.drop("treated", "_index_size").join(given, "_index"), covariates)


def refute_random_cause(rows: DataFrame, covariates: Sequence[str] = LATE_COVARIATES, seed: int = 42) -> DataFrame:
    """Effect with one more confounder that is pure noise; should stay as it was."""
    own = cut(numbered(rows.select("treated", "outcome", *covariates), seed))
    base = own.withColumn("random_cause", F.pmod(F.xxhash64(F.lit(seed), "_index"), F.lit(1 << 52)) / float(1 << 52))
    return ate_psm(base, [*covariates, "random_cause"])


@F.pandas_udf(T.LongType())
def _poisson(count: pd.Series, share: pd.Series) -> pd.Series:
    """Poisson draw with mean ``count`` at the uniform number ``share``, by inversion.

    The distribution function is summed up over 12 standard deviations and 40 on either side of the mean; what lies
    beyond is less than a step of ``share``.
    """
    c, u = count.to_numpy(float), share.to_numpy(float)
    out = np.zeros(len(c), dtype="int64")
    for mean in np.unique(c[c > 0]):
        at = np.flatnonzero(c == mean)
        reach = 12 * np.sqrt(mean) + 40
        k = np.arange(max(0, int(mean - reach)), int(mean + reach) + 1)
        first = k[0] * math.log(mean) - mean - math.lgamma(k[0] + 1)
        log = first + np.concatenate([[0.0], np.cumsum(np.log(mean / k[1:]))])
        out[at] = k[np.minimum(np.searchsorted(np.cumsum(np.exp(log)), u[at], "right"), len(k) - 1)]
    return pd.Series(out)


def ate_ci(rows: DataFrame, covariates: Sequence[str] = LATE_COVARIATES, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Bootstrap interval of the matched effect, all replicates in one pass.

    Counts are drawn per (cell, arm, outcome): a sum of n Poisson(1) weights is a Poisson(n) draw.
    """
    table = cut(add_propensity(cut(cells(rows, covariates)), covariates))
    kinds = F.array(*[
        F.struct(F.lit(t).alias("_t"), F.lit(y).alias("_y"), (F.col(f"y{t}") if y else F.col(f"n{t}") - F.col(f"y{t}")).alias("_c"))
        for t in (0, 1) for y in (0, 1)])
    long = table.select("score", *covariates, F.inline(kinds)).where("_c > 0")
    runs = long.withColumn("_run", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    share = F.pmod(F.xxhash64(F.lit(seed), "_run", "_t", "_y", *covariates), F.lit(1 << 52)) / float(1 << 52)
    drawn = runs.withColumn("_w", _poisson(F.col("_c").cast("long"), share))
    arm = lambda t, y: F.sum(F.when((F.col("_t") == t) & (F.col("_y") >= y), F.col("_w")).otherwise(0))
    again = drawn.groupBy(F.col("_run").alias("replicate"), "score").agg(
        arm(1, 0).alias("n1"), arm(1, 1).alias("y1"), arm(0, 0).alias("n0"), arm(0, 1).alias("y0"))
    effects = match_ate(nearest_score_match(cut(again), ["replicate"]), ["replicate"])
    limits = exact_quantiles(cut(effects), ["ate"], {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975})
    return limits.select("ci_low", "median", "ci_high", F.lit(replicates).alias("replicates"))


# --- What-if -----------------------------------------------------------------------------


def shipping_cost_delta(new_mode: str) -> Column:
    """Extra shipping cost per order if it went by ``new_mode``."""
    return F.lit(X.WHATIF_MODE_COST.get(new_mode, 0.0)) - X.lookup("shipping_mode", X.WHATIF_MODE_COST, 0.0)


def scenario_rows(df: DataFrame, name: str, condition: str, changes: Mapping, model: Ensemble,
                  levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Affected orders with their late probability before and after the change.

    The levels fitted with the model encode both versions, so an overridden column keeps its meaning.
    """
    rows = query_filter(df, condition)
    cost = shipping_cost_delta(changes["shipping_mode"]) if "shipping_mode" in changes else F.lit(0.0)
    rows = rows.withColumn("_cost", cost)
    before, dummies, _ = late_inputs(rows, levels)
    before = predict_probability(model, before, "_before", flag=None)
    added = [d for d in dummies if d not in df.columns]
    after, _, _ = late_inputs(override_columns(before.drop(*added, "label"), changes), levels)
    after = predict_probability(model, after, "_after", flag=None)
    return after.select(F.lit(name).alias("scenario"), "_before", "_after", "_cost", "profit")


def scenario_summary(rows: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("_before") - F.col("_after"), F.lit(0.0))
    out = rows.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("orders_affected"), (F.avg("_before") * 100).alias("baseline_late_pct"),
        (F.avg("_after") * 100).alias("changed_late_pct"), ((F.avg("_after") - F.avg("_before")) * 100).alias("late_delta_pp"),
        F.floor(F.sum(saved)).cast("bigint").alias("orders_saved"), F.sum("_cost").alias("shipping_cost_delta"),
        F.sum("profit").alias("baseline_profit"))
    return out.withColumn("net_profit", F.col("baseline_profit") - F.col("shipping_cost_delta"))


def whatif_compare(df: DataFrame, scenarios: Sequence[tuple[str, str, Mapping]], model: Ensemble,
                   levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per scenario that affects any order, in one aggregation."""
    rows = None
    for name, condition, changes in scenarios:
        part = scenario_rows(df, name, condition, changes, model, levels)
        rows = part if rows is None else rows.unionByName(part)
    return scenario_summary(rows)


def whatif_cost(df: DataFrame, condition: str, new_mode: str) -> DataFrame:
    """Orders, cost delta and profit of a mode change, without a model."""
    return query_filter(df, condition).agg(
        F.count(F.lit(1)).alias("orders_affected"), F.sum(shipping_cost_delta(new_mode)).alias("shipping_cost_delta"),
        F.sum("profit").alias("baseline_profit"))
