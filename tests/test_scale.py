"""Distributed building blocks against brute force, with hot groups and for several partitionings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import causal, density, scale, spatial, stats


@pytest.fixture(params=[1, 4, 64])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot_rows(n=600, seed=1):
    """One group owns a third of the rows and one value a third of that group."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{draw.randrange(8)}"
        rows.append((i, g, 5.0 if g == "hot" and i % 9 == 0 else round(draw.uniform(0, 10), 1)))
    return rows


def test_running_totals(spark, partitions):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(7)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    for r in scale.running_totals(counts, "v", {"n": "c"}, ["g"]).collect():
        same = [v for _, g, v in rows if g == r["g"]]
        assert r["n_before"] == sum(v < r["v"] for v in same)
        assert r["n_ties"] == sum(v == r["v"] for v in same) and r["n_all"] == len(same)


def test_exact_quantiles(spark, partitions):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, g string, v double")
    out = scale.exact_quantiles(df, ["v"], {"a": 0.25, "b": 0.5, "c": 0.9}, ["g"]).collect()
    for r in out:
        want = np.quantile([v for _, g, v in rows if g == r["g"]], [0.25, 0.5, 0.9])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(want))


def test_rows_are_numbered_once_and_alike(spark, partitions):
    df = spark.createDataFrame(hot_rows(), "id int, g string, v double").repartition(5)
    got = {r["id"]: r["_index"] for r in scale.row_index(df, ["g"]).collect()}
    sizes = df.groupBy("g").count().collect()
    assert sum(r["count"] for r in sizes) == len(got)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert got == {r["id"]: r["_index"] for r in scale.row_index(df.repartition(2), ["g"]).collect()}


def test_split_keeps_the_share_of_every_class(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id int, label int")
    out = scale.add_rank_share(df, ["label"]).where("_share < 0.8").groupBy("label").count()
    assert {r["label"]: r["count"] for r in out.collect()} == {0: 720, 1: 80}


def test_neighbours_with_equidistant_and_stacked_points(spark, partitions):
    draw = random.Random(2)
    pts = [(f"p{i:03d}", float(draw.randrange(12)), float(draw.randrange(12))) for i in range(150)]
    pts += [(f"q{i:03d}", 3.0, 3.0) for i in range(60)] + [(f"z{i}", 1000.0 + i, -500.0) for i in range(3)]
    got = {}
    for r in spatial.knn_join(spark.createDataFrame(pts, "id string, x double, y double"), 5).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i, x, y in pts:
        near = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, j) for j, a, b in pts if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in near]


def brute_dbscan(x, eps, least):
    near = ((x[:, None, :] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = k
                    todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        if len(reach):
            label[i] = reach.min()
    return label, near.sum(axis=1)


@pytest.mark.parametrize("limit", [100_000, 10])
def test_density_clusters(spark, monkeypatch, limit):
    """Chains, a crowded spot, equal points, border points, lone noise; once with forced box splitting."""
    monkeypatch.setattr(density, "SPLIT_ABOVE", limit)
    rng = np.random.default_rng(3)
    chain = np.c_[np.arange(0, 12, 0.25), np.zeros(48)]
    x = np.r_[chain, rng.normal(0, 0.15, (150, 2)) + [3, 5], np.repeat([[8.0, 8.0]], 40, axis=0), rng.uniform(-5, 15, (150, 2)),
              rng.normal(0, 0.5, (112, 2)) + [10, 3]]
    want, counts = brute_dbscan(x, 0.4, 4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["label"] for r in density.dbscan(df, ["a", "b"], 0.4, 4).collect()}
    assert [got[i] for i in range(len(x))] == list(want)
    n = {r["id"]: r["neighbours"] for r in density.neighbour_counts(df, ["a", "b"], 0.4).collect()}
    assert [n[i] for i in range(len(x))] == list(counts)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)]
    nodes = sorted({n for e in edges for n in e} | {5000})
    out = density.connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert all(r["root"] == (1 if r["node"] <= 300 else 1000 if r["node"] < 5000 else 5000) for r in out.collect())


def test_nearest_match(spark, partitions):
    draw = random.Random(4)
    rows = [(round(draw.random(), 2), draw.randrange(2), draw.randrange(2)) for _ in range(80)]
    cells = causal.cells(spark.createDataFrame(rows, "score double, treated int, outcome int"), ["score"])
    got = causal.match_ate(causal.nearest_score_match(cells)).first()["ate"]

    def other(s, t):
        arm = [(q, y) for q, k, y in rows if k != t]
        best = min((abs(q - s), q) for q, _ in arm)[1]
        same = [y for q, y in arm if q == best]
        return sum(same) / len(same)

    want = sum((y - other(s, t)) * (1 if t else -1) for s, t, y in rows) / len(rows)
    assert got == pytest.approx(want)


def test_kruskal_is_independent_of_partitions(spark):
    df = spark.createDataFrame([(g, v) for _, g, v in hot_rows()], "macro_region string, sales double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.append(stats.kruskal_wallis(df.repartition(n)).first()["h_statistic"])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == pytest.approx([seen[0]] * 3)
