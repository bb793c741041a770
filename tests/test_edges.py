"""Hand-made rows around the edges of each rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.functions.pvalues import beta_cdf, gamma_tail
from cargolens.operators import clean, cluster, features, finance, panel, risk, stats, verify
from cargolens.sources.orders import order_items, parse_date


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_median_mode_and_all_null_column(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None, 1), (2.0, "a", None, 2), (3.0, "b", None, 3), (10.0, "a", None, 4), (None, None, None, 5)],
        "x double, c string, empty double, id int")
    out = clean.impute_categorical_mode(clean.impute_numeric_median(df)).where("id = 5").first()
    assert (out["x"], out["c"], out["empty"]) == (2.5, "a", None)


def test_integer_column_takes_fractional_median(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert sorted(r[0] for r in clean.impute_numeric_median(df).collect()) == [1.0, 1.5, 2.0]


def test_tier_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.3, 0.5, 0.7, 0.8, 1.0, None)], "s double")
    risk_tier = X.cut_tiers("s", *X.RISK_TIERS, include_lowest=True)
    fraud_tier = X.cut_tiers("s", *X.FRAUD_TIERS, include_lowest=False)
    got = {r["s"]: (r["a"], r["b"]) for r in df.select("s", risk_tier.alias("a"), fraud_tier.alias("b")).collect()}
    assert got[0.0] == ("Low", None) and got[0.3] == ("Low", "Low") and got[0.7] == ("High", "High")
    assert got[0.8] == ("Critical", "High") and got[1.0] == ("Critical", "Critical") and got[None] == (None, None)


def test_score_of_exactly_seven_tenths_is_high_and_reviewed(spark):
    df = spark.createDataFrame([(1, "r", "m", 0.7, 0.7, 0.7)], "order_id int, order_region string, market string, p_late double, p_fraud double, p_cancel double")
    out = risk.composite_risk(df, {"late": 1.0, "fraud": 0.0, "cancel": 0.0}).first()
    assert (out["risk_tier"], out["requires_review"]) == ("High", 1)


def test_dates_month_first_and_bad(spark):
    df = spark.createDataFrame([("1/31/2018 22:56",), ("2017-02-03 04:05:06",), ("13/13/2017",), (None,)], "t string")
    got = [r[0] for r in df.select(F.to_date(parse_date("t"))).collect()]
    assert got == [dt.date(2018, 1, 31), dt.date(2017, 2, 3), None, None]


def test_lookup_of_unknown_and_null(spark):
    df = spark.createDataFrame([("Drone",), (None,), ("Same Day",)], "m string")
    assert [r[0] for r in df.select(X.lookup("m", X.TRADEOFF_MODE_COST, 0.0)).collect()] == [0.0, 0.0, 18.0]


def test_emission_names_match_in_table_order(spark):
    df = spark.createDataFrame([("none", "southeast asia"), ("none", "South Asia"), ("usca", "x"), (None, None)], "m string, r string")
    assert [r[0] for r in df.select(X.emission_factor("m", "r")).collect()] == [0.22, 0.25, 0.15, 0.20]


def test_kruskal_with_ties_and_a_group_of_one(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 5.0), ("d", 9.0)]
    out = stats.kruskal_wallis(spark.createDataFrame(rows, "macro_region string, sales double")).first()
    # Ranks of the eight values in groups of two or more: a 1, 3, 3; b 3, 5, 6; c 7.5, 7.5.
    h = 12 / (8 * 9) * (7 ** 2 / 3 + 14 ** 2 / 3 + 15 ** 2 / 2) - 27
    assert out["h_statistic"] == pytest.approx(h / (1 - (24 + 6) / (512 - 8))) and out["dof"] == 2


def test_two_by_two_table_is_corrected(spark):
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 15
    out = stats.chi_square(spark.createDataFrame(rows, "macro_region string, late_risk int")).first()
    n, det = 75, abs(10 * 15 - 20 * 30)
    assert out["chi2"] == pytest.approx(n * (det - n / 2) ** 2 / (30 * 45 * 40 * 35)) and out["dof"] == 1


def test_two_by_two_table_with_empty_cells(spark):
    rows = [("a", 0)] * 10 + [("b", 1)] * 10
    out = stats.chi_square(spark.createDataFrame(rows, "macro_region string, late_risk int")).first()
    assert out["chi2"] == pytest.approx(20 * (100 - 10) ** 2 / (10 * 10 * 10 * 10))


def test_tail_probabilities():
    assert gamma_tail(1.0, 2.0) == pytest.approx(0.1353352832366127)
    assert beta_cdf(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert beta_cdf(5.0, 0.5, 10 / (10 + 2.228138852 ** 2)) == pytest.approx(0.05, rel=1e-6)


def test_lags_count_rows_not_days(spark):
    rows = [("r", dt.date(2020, 1, d), float(d), 1.0, 0.5, 1) for d in (1, 5, 6)]
    p = spark.createDataFrame(rows, "macro_region string, date date, sales double, quantity double, late_risk double, unique_customers int")
    out = panel.add_rolls(panel.add_lags(p, (1,)), (7,)).orderBy("date").collect()
    assert [r["sales_lag_1"] for r in out] == [None, 1.0, 5.0] and [r["sales_roll_7"] for r in out] == [1.0, 3.0, 4.0]
    free = panel.add_rolls(p, (7,), leak_free=True).orderBy("date").collect()
    assert [r["sales_roll_7"] for r in free] == [None, 1.0, 3.0]


def test_split_orders_equal_dates_by_region(spark):
    rows = [(r, dt.date(2020, 1, d), 1.0) for d in (1, 2, 3, 4, 5) for r in ("b", "a")]
    out = panel.temporal_split(spark.createDataFrame(rows, "macro_region string, date date, sales double"))
    assert [r["row_index"] for r in out.orderBy("date", "macro_region").collect()] == list(range(10))
    assert out.agg(F.sum("is_train")).first()[0] == 7


def test_sequences_need_sixteen_weeks(spark):
    rows = [(dt.date(2020, 1, 6) + dt.timedelta(weeks=i), g, "c", float(i), 1.0, 0.1, 2) for g, n in (("short", 15), ("long", 16)) for i in range(n)]
    weekly = spark.createDataFrame(rows, "week date, order_region string, category_name string, total_quantity double, total_sales double, avg_discount double, order_count int")
    out = panel.sliding_sequences(weekly).collect()
    assert [(r["order_region"], len(r["inputs"]), len(r["targets"])) for r in out] == [("long", 12, 4)]


def test_equal_points_of_a_front_both_stay(spark):
    rows = [("g", 1.0, 0.5), ("g", 1.0, 0.5), ("g", 1.0, 0.6), ("g", 2.0, 0.4), ("g", 3.0, 0.4)]
    out = finance.pareto_front(spark.createDataFrame(rows, "market string, cost_proxy double, late_rate double"))
    assert values(out, "cost_proxy", "late_rate", "is_pareto") == [(1.0, 0.5, 1), (1.0, 0.5, 1), (1.0, 0.6, 0), (2.0, 0.4, 1), (3.0, 0.4, 0)]


def test_constant_measure_scores_one_half(spark):
    rows = [(i, 0.5, float(i), 0.1, 0.2) for i in range(3)]
    out = cluster.resilience_index(spark.createDataFrame(rows, "cluster_label int, demand_cv double, late_rate double, cancel_rate double, profit_cv double"))
    got = {r["cluster_label"]: r for r in out.collect()}
    assert got[0]["demand_stability_score"] == 0.5 and got[0]["delivery_reliability_score"] == 1.0


def test_curves_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 0), (0.1, 1)], "score double, label int")
    out = verify.ranking_scores(df).first()
    brute = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in (0.9, 0.5, 0.1) for q in (0.5, 0.5, 0.1)) / 9
    assert out["auc"] == pytest.approx(brute)
    assert verify.ranking_scores(df.where("label = 1")).first()["auc"] is None


def test_drift_limits_are_inclusive_for_rate_only(spark):
    labels, late = [0, 1, 0, 1, 1, 1], [0.10, 0.11, 0.12, 0.13, 0.14, 0.15]
    rows = [("r", dt.date(2019 + i // 4, 1 + 3 * (i % 4), 1), late[i], labels[i]) for i in range(6)]
    out = panel.drift_flags(spark.createDataFrame(rows, "order_region string, quarter_start date, late_rate double, cluster_label int"), worse=0.0101).first()
    assert (out["cluster_changes"], out["drift_rate"], out["is_drifting"], out["worsening"]) == (3, 0.6, 1, 0)


def test_unseen_level_gets_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",)], "c string")
    codes = features.level_codes(df, ["c"])
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert [r["c_code"] for r in features.add_codes(new, ["c"], codes).orderBy(F.col("c").asc_nulls_last()).collect()] == [0, 1, -1, -1]


def test_dimensions_that_are_not_asked_for_do_not_change_the_rows(spark, folder):
    assert order_items(spark, folder, ["sales"]).count() == order_items(spark, folder).count()
    plan = order_items(spark, folder, ["sales"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
