"""Spatial neighbours and autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.functions.pvalues import t_pvalue
from cargolens.operators.scale import BUCKET, row_index, with_buckets
from cargolens.session import cut, num_shuffle_partitions

_DEPTH = 24  # halvings of the square around all points; 2 * 24 bits of cell code fit a double exactly


def city_points(df: DataFrame, key: str = "order_city") -> DataFrame:
    """Mean place and late rate per city; incomplete cities are dropped."""
    return df.groupBy(F.col(key).alias("id")).agg(
        F.avg("latitude").alias("x"), F.avg("longitude").alias("y"), F.avg("late_risk").alias("value")
    ).dropna()


def _spread_bits(c: Column) -> Column:
    """Move the low 24 bits of an integer to every second bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def knn_join(points: DataFrame, k: int = 8) -> DataFrame:
    """Edges (src, dst, rank, distance) to the k nearest other points, ties by id. Exact.

    ``points`` has id, x, y. Points at one place are folded into a site that keeps its k + 1 smallest
    ids, which is all that any neighbour list can use. Sites are ordered along a space-filling curve;
    k + 1 neighbours on the curve that share a square bound the distance to the k-th neighbour, so each
    site only meets the sites in the nine squares around it, at a scale that fits the local density.
    """
    need = k + 1
    here = W.partitionBy("x", "y")
    heads = points.withColumn("_r", F.row_number().over(here.orderBy("id"))).where(F.col("_r") <= need)
    sites = heads.groupBy("x", "y").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    box = points.agg(F.struct(
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"),
    ).alias("b")).scalar()
    side = F.when(box.getField("side") > 0, box.getField("side")).otherwise(F.lit(1.0))
    top = (1 << _DEPTH) - 1

    def cell(c: str, low: str) -> Column:
        return F.least(F.floor((F.col(c) - box.getField(low)) / side * (1 << _DEPTH)), F.lit(top)).cast("bigint")

    sites = cut(
        sites.withColumn("cx", cell("x", "x0")).withColumn("cy", cell("y", "y0")).withColumn("side", side)
        .withColumn("code", _spread_bits(F.col("cx")).bitwiseOR(F.shiftleft(_spread_bits(F.col("cy")), 1)))
        .withColumn("_order", F.col("code").cast("double"))
    )
    along = W.partitionBy(BUCKET).orderBy("code", "x", "y")
    ahead = F.lead("code", k).over(along)
    shared = F.lit(_DEPTH) - F.ceil(F.length(F.bin(F.col("code").bitwiseXOR(F.col("_ahead")))) / 2)
    same = F.lit(_DEPTH)
    depth = F.when(F.col("_ahead").isNull(), F.lit(0)).when(F.col("_ahead") == F.col("code"), same).otherwise(shared)
    # Buckets much longer than k, so that nearly every window is whole; a cut one only widens a search.
    parts = max(1, min(num_shuffle_partitions(points.sparkSession), sites.count() // (200 * need)))
    local = with_buckets(sites, "_order", parts).withColumn("_ahead", ahead).withColumn("_d", depth.cast("int")) \
        .withColumn("depth", F.max("_d").over(along.rowsBetween(-k, 0))).drop("_ahead", "_d", BUCKET, "_order")
    local = cut(local)

    # Level to search: one coarser than the crowded square, so that the nine squares cover its diagonal.
    level = F.greatest(F.col("depth") - 1, F.lit(0))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asks = local.select(
        F.col("x").alias("qx"), F.col("y").alias("qy"), level.alias("level"), "cx", "cy",
        (F.col("side") * F.sqrt(F.lit(2.0)) / F.pow(F.lit(2.0), F.col("depth")) * (1 + 1e-9)).alias("reach"), "depth",
    )
    shift = F.lit(_DEPTH) - F.col("level")
    asks = asks.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select(
        "qx", "qy", "level", "reach", "depth",
        (F.expr(f"shiftright(cx, {_DEPTH} - level)") + F.col("_dx")).alias("gx"),
        (F.expr(f"shiftright(cy, {_DEPTH} - level)") + F.col("_dy")).alias("gy"),
    )
    used = [r[0] for r in local.select(level.alias("l")).distinct().collect()]  # at most 24 numbers
    held = local.select(
        "x", "y", "ids", "cx", "cy", F.explode(F.array(*[F.lit(int(v)) for v in used])).alias("level")
    ).select(
        "x", "y", "ids", "level", F.expr(f"shiftright(cx, {_DEPTH} - level)").alias("gx"),
        F.expr(f"shiftright(cy, {_DEPTH} - level)").alias("gy"),
    )
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    distance = F.sqrt(dx * dx + dy * dy)
    # Depth 0 has no crowded square below the whole box: every site is a candidate there.
    near = asks.join(held, ["level", "gx", "gy"]).withColumn("distance", distance) \
        .where((F.col("distance") <= F.col("reach")) | (F.col("depth") == 0))
    ranked = near.select("qx", "qy", "distance", F.explode("ids").alias("dst")).withColumn(
        "_r", F.row_number().over(W.partitionBy("qx", "qy").orderBy("distance", "dst"))
    ).where(F.col("_r") <= need)
    lists = ranked.groupBy("qx", "qy").agg(
        F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near")
    )
    joined = points.join(lists, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")))
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k)
    return joined.select(F.col("id").alias("src"), F.posexplode(others).alias("_p", "_e")).select(
        "src", F.col("_e.dst").alias("dst"), (F.col("_p") + 1).alias("rank"), F.col("_e.distance").alias("distance")
    )


def spatial_lag(points: DataFrame, k: int = 8) -> DataFrame:
    """Per point: z-score (population deviation), mean z of its neighbours, quadrant."""
    edges = knn_join(points.select("id", "x", "y"), k)
    m = points.agg(F.struct(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).alias("v")).scalar()
    z = points.select("id", ((F.col("value") - m.getField("m")) / m.getField("s")).alias("z"))
    lag = edges.join(z.withColumnRenamed("id", "dst").withColumnRenamed("z", "_nz"), "dst") \
        .groupBy(F.col("src").alias("id")).agg(F.avg("_nz").alias("lag"))
    high, lag_high = F.col("z") >= 0, F.col("lag") >= 0
    quadrant = F.when(high & lag_high, "HH").when(~high & ~lag_high, "LL").when(high, "HL").otherwise("LH")
    return z.join(lag, "id").withColumn("quadrant", quadrant)


def morans_i(points: DataFrame, k: int = 8) -> DataFrame:
    """Moran's I with the slope test of lag on z. No row below 10 points or without variance."""
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("s")).first()
    k = min(k, facts["n"] - 1)
    lag = spatial_lag(points.where(F.lit(facts["n"] >= 10 and bool(facts["s"]))), max(k, 1))
    t = lag.agg(
        F.count(F.lit(1)).cast("double").alias("n"), (F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("morans_i"),
        F.regr_slope("lag", "z").alias("slope"), F.corr("lag", "z").alias("_r"),
    ).where("n >= 10")
    out = t.withColumn("_dof", F.col("n") - 2) \
        .withColumn("_t", F.col("_r") * F.sqrt(F.col("_dof") / (1 - F.col("_r") * F.col("_r"))))
    return out.select("n", "morans_i", "slope", t_pvalue("_t", "_dof").alias("p_value"))


def moran_permutation(points: DataFrame, replicates: int = 99, k: int = 8, seed: int = 42) -> DataFrame:
    """Permutation p-value of Moran's I: values are dealt out anew over fixed edges.

    Points are numbered once; each replicate numbers them again in a hash order of its own and hands the
    value with number p to the point with number p. Numbers come from ordered buckets, so no task holds all
    points of a replicate; one aggregation over (replicate, edge) gives all statistics together. Replicate 0
    keeps the values where they are.
    """
    edges = cut(knn_join(points.select("id", "x", "y"), k))
    m = points.agg(F.struct(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).alias("v")).scalar()
    z = points.select("id", ((F.col("value") - m.getField("m")) / m.getField("s")).alias("z"))
    numbered = cut(row_index(z, seed=seed, alias="place").select("id", "z", "place"))
    runs = numbered.select("z", "place").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    deal = F.when(F.col("run") == 0, F.col("place")).otherwise(F.col("deal"))
    given = row_index(runs, ["run"], seed, alias="deal").select("run", deal.alias("place"), "z")
    dealt = cut(given.join(numbered.select("id", "place"), "place").select("run", "id", "z"))
    pairs = edges.join(dealt.withColumnRenamed("id", "src").withColumnRenamed("z", "zs"), "src") \
        .join(dealt.withColumnRenamed("id", "dst").withColumnRenamed("z", "zd"), ["dst", "run"])
    stats = pairs.groupBy("run").agg((F.sum(F.col("zs") * F.col("zd")) / F.count(F.lit(1))).alias("i"))
    seen = F.max(F.when(F.col("run") == 0, F.col("i")))
    observed = stats.agg(seen).scalar()
    return stats.agg(
        seen.alias("morans_i"), (F.lit(-1.0) / (points.agg(F.count(F.lit(1))).scalar() - 1)).alias("expected_i"),
        ((F.count_if((F.col("run") > 0) & (F.col("i") >= observed)) + 1) / F.lit(replicates + 1.0)).alias("p_value"),
    )
