"""Queries for clustering, density clusters and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import cluster, density, panel
from cargolens.plans.inputs import KEYS, items
from cargolens.plans.models import best_centres, labelled, once, scaled, scaled_numbered, sweep, table
from cargolens.plans.registry import query
from cargolens.plans.sql import FEAT, OI, R
from cargolens.session import cut


Z = ", ".join(f"{R(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 5)} AS {c}_z" for c in cluster.CLUSTER_FEATURES)


@query("cluster_features", f"WITH {FEAT} SELECT {', '.join(KEYS)}, {Z} FROM feat")
def q_features(spark, sf):
    rows, names = scaled(spark, sf)
    return rows.select(*KEYS, *[X.rnd(c, 5).alias(c) for c in names])


@query("kmeans_sweep")
def q_sweep(spark, sf):
    return sweep(spark, sf)[0]


def best_labels(spark, sf):
    """The complete rows with their scaled features and the labels of the best sweep."""
    def build():
        rows, names = scaled(spark, sf)
        return cut(cluster.attach_labels(rows, best_centres(spark, sf), names))

    return once(spark, sf, "kmeans_labels", build)


@query("attach_labels")
def q_attach(spark, sf):
    """A label on every order line of the feature table, incomplete ones included."""
    return labelled(spark, sf).select(*KEYS, "kmeans_cluster")


@query("kmeans_silhouette")
def q_silhouette(spark, sf):
    return cluster.silhouette(best_labels(spark, sf), scaled(spark, sf)[1], "kmeans_cluster")


@query("kmeans_davies_bouldin")
def q_kmeans_db(spark, sf):
    return cluster.davies_bouldin(best_labels(spark, sf), scaled(spark, sf)[1], "kmeans_cluster")


@query("kmeans_profiles")
def q_profiles(spark, sf):
    from cargolens.operators.aggregate import cluster_profiles

    return cluster_profiles(best_labels(spark, sf), "kmeans_cluster")


DB = OI + """, p AS (SELECT store_id % 5 AS label, sales/10000 AS a, quantity/10 AS b, days_real::DOUBLE AS c FROM oi),
ce AS (SELECT label, avg(a) AS ca, avg(b) AS cb, avg(c) AS cc FROM p GROUP BY 1),
st AS (SELECT label, avg(sqrt((a-ca)^2+(b-cb)^2+(c-cc)^2)) AS s, any_value(ca) AS ca, any_value(cb) AS cb, any_value(cc) AS cc FROM p JOIN ce USING (label) GROUP BY 1),
w AS (SELECT x.label, max((x.s+y.s)/sqrt((x.ca-y.ca)^2+(x.cb-y.cb)^2+(x.cc-y.cc)^2)) AS r FROM st x JOIN st y ON x.label <> y.label GROUP BY 1)"""


@query("davies_bouldin", f"WITH {DB} SELECT {R('avg(r)', 4)} AS davies_bouldin, count(*) AS clusters FROM w")
def q_db(spark, sf):
    df = items(spark, sf, "store_id", "sales", "quantity", "days_real").select(
        (F.col("store_id") % 5).alias("label"), (F.col("sales") / 10000).alias("a"), (F.col("quantity") / 10).alias("b"),
        F.col("days_real").cast("double").alias("c"))
    return cluster.davies_bouldin(df, ["a", "b", "c"], "label").withColumn("davies_bouldin", X.rnd("davies_bouldin", 4))


@query("region_segments")
def q_segments(spark, sf):
    return cluster.region_segments(table(spark, sf))


# --- Density -----------------------------------------------------------------------------

# Products as points: mean sales, mean quantity, late rate over all their order lines.
PTS = OI + """, pt AS (SELECT product_id AS id, avg(sales)/10000 AS a, avg(quantity)/5 AS b, avg(late_risk)*3 AS c FROM oi GROUP BY 1),
nb AS (SELECT x.id AS src, y.id AS dst FROM pt x JOIN pt y ON (x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.c-y.c)*(x.c-y.c) <= {e2}::DOUBLE)"""


def product_points(spark, sf):
    return cut(items(spark, sf, "product_id", "sales", "quantity", "late_risk").groupBy(F.col("product_id").alias("id")).agg(
        (F.avg("sales") / 10000).alias("a"), (F.avg("quantity") / 5).alias("b"), (F.avg("late_risk") * 3).alias("c")))


@query("eps_join", f"WITH {PTS.format(e2=0.3 * 0.3)} SELECT src AS id, count(*) AS neighbours FROM nb GROUP BY 1")
def q_eps(spark, sf):
    return density.neighbour_counts(product_points(spark, sf), ["a", "b", "c"], 0.3)


@query("dbscan", f"""
WITH RECURSIVE {PTS.format(e2=0.2 * 0.2)}, co AS (SELECT src AS id FROM nb GROUP BY 1 HAVING count(*) >= 10),
ed AS (SELECT src, dst FROM nb WHERE src IN (FROM co) AND dst IN (FROM co)),
re AS (SELECT id AS src, id AS dst FROM co UNION SELECT re.src, ed.dst FROM re JOIN ed ON ed.src = re.dst),
ro AS (SELECT src AS id, min(dst) AS root FROM re GROUP BY 1), lb AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM ro),
bo AS (SELECT nb.src AS id, min(lb.label) AS label FROM nb JOIN lb ON lb.id = nb.dst WHERE nb.src NOT IN (FROM co) GROUP BY 1)
SELECT pt.id, coalesce(lb.label, bo.label, -1)::INT AS label FROM pt LEFT JOIN lb USING (id) LEFT JOIN bo USING (id)""")
def q_dbscan(spark, sf):
    return density.dbscan(product_points(spark, sf), ["a", "b", "c"], 0.2, 10)


@query("dbscan_sweep")
def q_dbscan_sweep(spark, sf):
    return cluster.dbscan_sweep(product_points(spark, sf), ["a", "b", "c"])


@query("dbscan_order_lines")
def q_dbscan_rows(spark, sf):
    rows, names = scaled_numbered(spark, sf)
    labels = once(spark, sf, "dbscan", lambda: cut(density.dbscan(rows, names, 0.5, 10)))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


# --- Drift -------------------------------------------------------------------------------


@query("cluster_drift")
def q_drift(spark, sf):
    return cluster.cluster_drift(items(spark, sf, "order_date", "order_region", "late_risk", "quantity", "sales", "order_id"))


@query("quarterly_clusters")
def q_quarterly(spark, sf):
    q = panel.quarterly_regions(items(spark, sf, "order_date", "order_region", "late_risk", "quantity", "sales", "order_id"))
    return cluster.quarterly_clusters(q).select("quarter", "order_region", "late_rate", "cluster_label")
