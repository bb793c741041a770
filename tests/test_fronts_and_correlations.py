"""Fronts of one crowded group and pairwise correlations against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import aggregate, finance


def brute(rows, d):
    out = {}
    for g, *x in rows:
        mine = [r[1:] for r in rows if r[0] == g and None not in r[1:]]
        if None in x:
            out[g, tuple(x)] = 0
            continue
        out[g, tuple(x)] = int(not any(all(a <= b for a, b in zip(o, x)) and any(a < b for a, b in zip(o, x)) for o in mine))
    return out


@pytest.mark.parametrize("aims,block", [(2, 4096), (3, 4096), (3, 40), (4, 25)])
def test_one_group_holds_nine_tenths(spark, monkeypatch, aims, block):
    monkeypatch.setattr(finance, "FRONT_BLOCK", block)
    draw = np.random.default_rng(aims)
    rows = []
    for i in range(700):
        x = draw.dirichlet(np.ones(aims)) + 0.05 * draw.random(aims) if i % 3 else draw.random(aims) * 2
        rows.append((None if i % 50 == 0 else "hot" if i % 10 else "cold", *[round(float(v), 2) for v in x]))
    rows += rows[:30] + [("cold", None, *[0.0] * (aims - 1))]
    names = [f"x{i}" for i in range(aims)]
    df = spark.createDataFrame(rows, ["market", *names]).repartition(7)
    got = finance.pareto_front(df, "market", *names).collect()
    want = brute(rows, aims)
    assert len(got) == len(rows) and all(r["is_pareto"] == want[r["market"], tuple(r[n] for n in names)] for r in got)
    assert sum(r["is_pareto"] for r in got) > 40 or aims == 2


def test_front_of_nothing(spark):
    assert finance.pareto_front(spark.createDataFrame([], "market string, cost_proxy double, late_rate double")).count() == 0


def test_correlations_over_known_pairs(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 4)) * [1, 100, 0.01, 1] + [1e9, 0, 5, 0]
    x[:, 1] += 50 * (x[:, 0] - 1e9)
    x[draw.random(x.shape) < 0.2] = np.nan
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(9) \
        .withColumn("same", F.lit(3.0)).withColumn("none", F.lit(None).cast("double"))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in aggregate.correlation_matrix(df, [*names, "same", "none", "absent"]).collect()}
    assert len(got) == 36 and all(got[n, n] == 1.0 for n in [*names, "same", "none"])
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[a, b] == pytest.approx(np.corrcoef(x[both, i] - x[both, i].mean(), x[both, j] - x[both, j].mean())[0, 1], abs=1e-6)
        assert got[a, "same"] is None and got["none", a] is None
    empty = aggregate.correlation_matrix(df.limit(0), names).collect()
    assert len(empty) == 16 and sum(r["r"] is None for r in empty) == 12
