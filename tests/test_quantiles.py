"""Exact quantiles by brackets against sorted lists, on large, small, hot and null groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import scale

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.93, "top": 1.0}


def check(df, columns, by=()):
    got = {(tuple(r[c] for c in by), r["column"]): [r[p] for p in PROBS] for r in scale.exact_quantiles(df, columns, PROBS, by).collect()}
    rows = df.collect()
    want = {}
    for c in columns:
        for g in {tuple(r[k] for k in by) for r in rows}:
            v = [float(r[c]) for r in rows if tuple(r[k] for k in by) == g and r[c] is not None and r[c] == r[c]]
            if v:
                want[g, c] = list(np.quantile(v, list(PROBS.values())))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds most rows, others few; one is null; values repeat, are missing, or not a number."""
    df = spark.range(40_000).select(
        "id", F.when(F.col("id") < 36_000, "hot").when(F.col("id") < 39_990, F.concat(F.lit("g"), (F.col("id") % 9).cast("string"))).alias("g"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise(F.rand(3) * 1000).alias("x"),
        (F.col("id") * 7919 % 23).cast("int").alias("few"))
    return df.cache()


def test_all_rows(rows):
    check(rows, ["x", "few"])


def test_groups(rows):
    check(rows, ["x", "few"], ["g"])


def test_two_keys_and_small_groups(rows):
    check(rows.limit(2000), ["x"], ["g", "few"])


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("b", 5.0)], "g string, x double")
    check(df, ["x"], ["g"])
    check(df.limit(0), ["x"])
    check(df.where("x IS NULL"), ["x"])


@pytest.mark.parametrize("n", [scale.SMALL_GROUP - 1, scale.SMALL_GROUP, scale.SMALL_GROUP + 1, scale.SMALL_GROUP + 7])
def test_at_the_border_of_small_groups(spark, n):
    check(spark.range(n).select((F.hash("id") % 10_007).cast("double").alias("x")), ["x"])


def test_only_brackets_are_kept(rows, monkeypatch):
    kept = []
    plain = scale.running_totals
    monkeypatch.setattr(scale, "running_totals", lambda df, *a, **k: kept.append(df.count()) or plain(df, *a, **k))
    scale.exact_quantiles(rows, ["x"], {"mid": 0.5}).collect()
    assert kept[0] < rows.count() / 100
