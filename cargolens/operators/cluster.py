"""Clustering of order lines and regions, resilience index, quarterly drift."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import kmeans
from cargolens.operators.density import dbscan
from cargolens.operators.features import minmax_scale, standard_scale
from cargolens.operators.kmeans import STARTS, Centres
from cargolens.operators.panel import drift_flags, quarterly_regions
from cargolens.operators.scale import attach
from cargolens.schema import present
from cargolens.session import cut, fit_all, sized

# Weights of the resilience index.
RESILIENCE_WEIGHTS = {
    "demand_stability_score": ("demand_cv", 0.30),
    "delivery_reliability_score": ("late_rate", 0.35),
    "order_integrity_score": ("cancel_rate", 0.20),
    "profit_consistency_score": ("profit_cv", 0.15),
}


def resilience_index(metrics: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Scores 1 - scaled measure (lower measures are better), their weighted sum, and its tier."""
    metrics = sized(metrics)  # one row per cluster, read for the limits and for the scores
    measures = [m for m, _ in RESILIENCE_WEIGHTS.values()]
    out = minmax_scale(metrics, measures, "_scaled", constant=0.5)
    out = out.withColumns({s: 1 - F.col(f"{m}_scaled") for s, (m, _) in RESILIENCE_WEIGHTS.items()})
    index = sum((F.lit(w) * F.col(s) for s, (_, w) in RESILIENCE_WEIGHTS.items()), F.lit(0.0))
    edges, labels = X.RESILIENCE_TIERS
    out = out.withColumn("resilience_index", index) \
        .withColumn("resilience_tier", X.cut_tiers("resilience_index", edges, labels, include_lowest=True)) \
        .withColumn("tier_order", X.tier_order("resilience_tier", labels))
    return out.drop(*[f"{m}_scaled" for m in measures]).orderBy(F.desc("resilience_index"), label)


# --- K-Means -----------------------------------------------------------------------------

CLUSTER_FEATURES = [
    "latitude", "longitude", "shipping_distance_km", "days_real", "sales", "quantity", "late_risk",
    "weather_risk", "region_late_rate", "region_avg_order_value",
]


def cluster_features(df: DataFrame, candidates: Sequence[str] = CLUSTER_FEATURES) -> tuple[DataFrame, list[str]]:
    """Complete rows with z-scored features (``*_z``) of those candidates that exist."""
    names = present(df, candidates)
    out = standard_scale(df.dropna(subset=names), names)
    return out, [f"{c}_z" for c in names]


def with_vector(df: DataFrame, features: Sequence[str], alias: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=alias).transform(df)


def kmeans_sweep(vectors: DataFrame, ks: Sequence[int] = range(2, 11), seed: int = 42, starts: int = STARTS) -> tuple[DataFrame, dict[int, Centres]]:
    """Inertia and silhouette per k. Returns the table (one row per k) and the fitted centres.

    Of ``starts`` fits per k the one with the lowest inertia is kept; all fits of all k share their passes over the rows.
    The silhouette uses squared distances, which need one more pass.
    """
    models, scores = kmeans.sweep(vectors.select(vector_to_array("features").alias("x")), ks, starts, seed)
    best = max(scores, key=lambda k: (scores[k], -k), default=None)
    table = [(k, models[k].inertia, scores[k], int(k == best)) for k in models]
    return vectors.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double, is_best int").orderBy("k"), models


def attach_labels(df: DataFrame, model: Centres, features: Sequence[str], alias: str = "kmeans_cluster", missing: int = 0) -> DataFrame:
    """Cluster label on every row; incomplete rows get ``missing``."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    x = F.when(whole, F.array(*[F.col(f).cast("double") for f in features]))
    return df.withColumn(alias, F.coalesce(model.label(x), F.lit(missing)))


@dataclass
class Labeller:
    """All that a cluster label needs: features, their means and deviations among the rows fitted on, centres."""

    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    model: Centres

    @staticmethod
    def of(df: DataFrame, model: Centres, candidates: Sequence[str] = CLUSTER_FEATURES) -> Labeller:
        """For a model fitted on ``cluster_features`` of ``df``."""
        known = present(df, candidates)
        m = df.dropna(subset=known).agg(*[e for i, c in enumerate(known) for e in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        return Labeller(known, np.array([m[f"m{i}"] or 0.0 for i in range(len(known))]), np.array([m[f"s{i}"] or 1.0 for i in range(len(known))]), model)

    def label(self, df: DataFrame, alias: str = "kmeans_cluster", missing: int = 0) -> DataFrame:
        """Every row with its label; incomplete rows, and all rows where a feature's column is absent, get ``missing``."""
        if not set(self.features) <= set(df.columns):
            return df.withColumn(alias, F.lit(missing))
        x = [F.col(c).cast("double") for c in self.features]
        whole = F.lit(True)
        for c in x:
            whole = whole & c.isNotNull() & ~F.isnan(c)
        return df.withColumn(alias, F.coalesce(self.model.label(F.when(whole, F.array(*x)), self.mean, self.deviation), F.lit(missing)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, float(m), float(d), [float(v) for v in v_]) for i, (c, m, d, v_) in enumerate(zip(self.features, self.mean, self.deviation, self.model.centres.T))]
        return spark.createDataFrame(rows, "place int, feature string, mean double, deviation double, centres array<double>")

    @staticmethod
    def read(table: DataFrame) -> Labeller:
        rows = table.orderBy("place").collect()  # one row per feature
        centres = np.array([r["centres"] for r in rows]).T
        return Labeller([r["feature"] for r in rows], np.array([r["mean"] for r in rows]), np.array([r["deviation"] for r in rows]),
                        Centres(centres, float("nan"), np.zeros(len(centres))))


def label_all(df: DataFrame, model: Centres, candidates: Sequence[str] = CLUSTER_FEATURES, alias: str = "kmeans_cluster", missing: int = 0) -> DataFrame:
    """``df`` with a cluster label on every row; rows that ``cluster_features`` left out as incomplete get ``missing``."""
    return Labeller.of(df, model, candidates).label(df, alias, missing)


def silhouette(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Silhouette over all rows, by squared distances, which need one linear pass instead of all pairs."""
    vectors = with_vector(df.select(*features, F.col(label).cast("double").alias(label)), features)
    value = ClusteringEvaluator(featuresCol="features", predictionCol=label, metricName="silhouette").evaluate(vectors)
    return df.agg(F.lit(float(value)).alias("silhouette"), F.count(F.lit(1)).alias("rows"))


def davies_bouldin(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    centres = df.groupBy(label).agg(*[F.avg(f).alias(f"_c{i}") for i, f in enumerate(features)])
    joined = attach(df.select(label, *features), centres, label)
    d2 = sum(((F.col(f) - F.col(f"_c{i}")) * (F.col(f) - F.col(f"_c{i}")) for i, f in enumerate(features)), F.lit(0.0))
    stats = sized(joined.groupBy(label).agg(F.avg(F.sqrt(d2)).alias("s"), *[F.first(f"_c{i}").alias(f"_c{i}") for i in range(len(features))]))
    other = stats.select(F.col(label).alias("_o"), F.col("s").alias("so"), *[F.col(f"_c{i}").alias(f"_o{i}") for i in range(len(features))])
    gap2 = sum(((F.col(f"_c{i}") - F.col(f"_o{i}")) * (F.col(f"_c{i}") - F.col(f"_o{i}")) for i in range(len(features))), F.lit(0.0))
    worst = stats.join(other, F.col(label) != F.col("_o")).groupBy(label).agg(
        F.max((F.col("s") + F.col("so")) / F.sqrt(gap2)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"), F.count(F.lit(1)).alias("clusters"))


# Radii tried by the density sweep.
EPS_GRID = (0.3, 0.5, 0.7, 1.0, 1.5)


def dbscan_sweep(points: DataFrame, features: Sequence[str], grid: Sequence[float] = EPS_GRID, min_samples: int = 10) -> DataFrame:
    """Clusters, noise and silhouette of the non-noise rows per radius, over all points.

    Radii with fewer than two clusters or eleven clustered rows have no silhouette. The best one is marked;
    without any, 0.5 is.
    """
    points = cut(points.select("id", *features))

    def radius(eps: float) -> tuple:
        labels = cut(dbscan(points, features, eps, min_samples))
        facts = labels.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"),
                           F.count_if(F.col("label") < 0).alias("noise"), F.count_if(F.col("label") >= 0).alias("m")).first()
        sil = None
        if facts["k"] >= 2 and facts["m"] > 10:
            sil = silhouette(points.join(labels.where("label >= 0"), "id"), features, "label").first()["silhouette"]
        return float(eps), int(facts["k"]), int(facts["noise"]), sil

    found = fit_all(points.sparkSession, {i: partial(radius, eps) for i, eps in enumerate(grid)})
    rows = [found[i] for i in range(len(grid))]
    scored = [r for r in rows if r[3] is not None and r[3] > -1]
    best = max(scored, key=lambda r: r[3])[0] if scored else 0.5
    return points.sparkSession.createDataFrame(
        [(*r, int(r[0] == best)) for r in rows], "eps double, clusters int, noise int, silhouette double, is_best int")


def region_segments(df: DataFrame, features: Sequence[str] = CLUSTER_FEATURES, key: str = "macro_region") -> DataFrame:
    """Regions grouped by their mean features into at most four segments, split from the top down.

    Nothing is returned for fewer than three regions.
    """
    names = present(df, features)
    means = sized(df.groupBy(key).agg(*[F.avg(f).alias(f) for f in names]).dropna())
    n = means.count()
    if n < 3:
        return means.select(key, F.lit(0).alias("segment")).limit(0)
    vectors = with_vector(standard_scale(means, names), [f"{c}_z" for c in names])
    model = BisectingKMeans(k=min(4, n - 1), seed=42, featuresCol="features", predictionCol="segment").fit(vectors)
    return model.transform(vectors).select(key, "segment")


# --- Quarterly clusters ------------------------------------------------------------------


def _quarter_labels(k: int):
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        """Lloyd iterations over the regions of one quarter, best of several seeded starts."""
        x = part[["late_rate", "demand_vol", "avg_sales"]].fillna(0.0).to_numpy(float)
        order = np.lexsort(x.T)
        draw = np.random.default_rng(42)
        best = None
        for _ in range(10):
            centres = x[draw.choice(order, size=min(k, len(x)), replace=False)]
            for _ in range(300):
                near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
                if np.allclose(moved, centres):
                    break
                centres = moved
            cost = ((x - centres[near]) ** 2).sum()
            if best is None or cost < best[0] - 1e-12:
                best = (cost, near, centres)
        _, near, centres = best
        rank = np.argsort(np.lexsort((centres[:, 2], centres[:, 0])))  # label 0 has the lowest late rate
        return part.assign(cluster_label=rank[near].astype("int32"))

    return fit


def quarterly_clusters(quarters: DataFrame, k: int = 5) -> DataFrame:
    """Cluster the regions of each quarter; labels are ordered by late rate so that quarters compare.

    One group holds one row per region of a quarter, already aggregated.
    """
    schema = ", ".join(f"{c} {t}" for c, t in quarters.dtypes) + ", cluster_label int"
    return quarters.groupBy("quarter").applyInPandas(_quarter_labels(k), schema)


def cluster_drift(df: DataFrame, k: int = 5) -> DataFrame:
    return drift_flags(cut(quarterly_clusters(quarterly_regions(df, k), k)))
