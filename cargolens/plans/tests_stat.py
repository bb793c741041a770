"""Queries for hypothesis tests, spatial statistics, residuals and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.pvalues import NORMAL_FAR, NORMAL_MIDDLE, NORMAL_SIDE
from cargolens.functions import columns as X
from cargolens.operators import features, spatial, stats
from cargolens.plans.inputs import items, regional, rule_scores, KEYS
from cargolens.plans.registry import query
from cargolens.plans.sql import GEO, OI, SCORED, R


def _round(df, places, *names):
    return df.withColumns({n: X.rnd(n, places) for n in names})


def chi2_tail(stat: str, dof: str) -> str:
    """SQL of the chi-square tail for an even number of degrees of freedom (a finite sum)."""
    return (f"exp(-({stat})/2) * list_sum(list_transform(range(0, ({dof}//2)::BIGINT), "
            f"lambda i: CASE WHEN i = 0 THEN 1.0 ELSE exp(i*ln(({stat})/2) - lgamma(i+1)) END))")


def f_tail(stat: str, df1: str, df2: str) -> str:
    """SQL of the F tail for an even numerator: a finite sum over its half."""
    y = f"(({df2})/(({df2}) + ({df1})*({stat})))"
    return (f"list_sum(list_transform(range(0, ({df1}//2)::BIGINT), lambda i: exp(({df2})/2.0*ln({y}) + lgamma(({df2})/2.0 + i) - lgamma(({df2})/2.0)"
            f" - lgamma(i+1.0) + CASE WHEN i = 0 THEN 0.0 ELSE i*ln(1-{y}) END)))")


AN = """g AS (SELECT macro_region, count(*) AS n, avg(days_real) AS m, var_pop(days_real) AS v FROM oi GROUP BY 1 HAVING count(*) >= 2),
a AS (SELECT count(*)-1 AS d1, sum(n)-count(*) AS d2, (sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1) AS msb, sum(n*v)/(sum(n)-count(*)) AS msw FROM g)"""


@query("anova_oneway", f"WITH {OI}, {AN} SELECT {R('msb/msw')} AS f_statistic, d1::DOUBLE AS df1, d2::DOUBLE AS df2, {R(f_tail('msb/msw', 'd1', 'd2'))} AS p_value FROM a")
def q_anova(spark, sf):
    return _round(stats.anova_oneway(regional(spark, sf, "days_real")), 6, "f_statistic", "p_value")


CH = """o AS (SELECT macro_region, late_risk, count(*) AS o FROM oi GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY macro_region) AS r,
 sum(o) OVER (PARTITION BY late_risk) AS c, sum(o) OVER () AS n FROM o),
x AS (SELECT sum((o - r*c/n)*(o - r*c/n)/(r*c/n)) AS chi2, (count(DISTINCT macro_region)-1)*(count(DISTINCT late_risk)-1) AS dof FROM e)"""


@query("chi_square", f"WITH {OI}, {CH} SELECT {R('chi2')} AS chi2, dof::DOUBLE AS dof, {R(chi2_tail('chi2', 'dof'))} AS p_value FROM x")
def q_chi(spark, sf):
    return _round(stats.chi_square(regional(spark, sf, "late_risk")), 6, "chi2", "p_value")


KW = """k AS (SELECT macro_region, sales, rank() OVER (ORDER BY sales) + (count(*) OVER (PARTITION BY sales) - 1)/2.0::DOUBLE AS rk,
 count(*) OVER (PARTITION BY sales)::DOUBLE AS t, count(*) OVER ()::DOUBLE AS n FROM oi),
kg AS (SELECT macro_region, sum(rk) AS rs, count(*) AS c, sum(t*t-1) AS tp, any_value(n) AS n FROM k GROUP BY 1),
kh AS (SELECT (12/(any_value(n)*(any_value(n)+1))*sum(rs*rs/c) - 3*(any_value(n)+1))/(1 - sum(tp)/(any_value(n)^3 - any_value(n))) AS h, count(*)-1 AS dof FROM kg)"""


@query("kruskal_wallis", f"WITH {OI}, {KW} SELECT {R('h', 5)} AS h_statistic, dof::DOUBLE AS dof, {R(chi2_tail('h', 'dof'))} AS p_value FROM kh")
def q_kruskal(spark, sf):
    return _round(_round(stats.kruskal_wallis(regional(spark, sf, "sales")), 5, "h_statistic"), 6, "p_value")


@query("pearson_test", f"WITH {GEO} SELECT {R('corr(shipping_distance_km, days_real)')} AS r, count(*)::DOUBLE AS n FROM geo WHERE shipping_distance_km > 0")
def q_pearson(spark, sf):
    df = features.add_distance(items(spark, sf, "order_country", "latitude", "longitude", "days_real"))
    return _round(stats.pearson_test(df), 6, "r").drop("p_value")


TT = """w AS (SELECT days_real AS d, isodow(order_date) >= 6 AS e FROM oi), s AS (SELECT count(*) FILTER (e) AS n1, count(*) FILTER (NOT e) AS n0,
 avg(d) FILTER (e) AS m1, avg(d) FILTER (NOT e) AS m0, var_samp(d) FILTER (e) AS v1, var_samp(d) FILTER (NOT e) AS v0 FROM w)"""


@query("t_test", f"""
WITH {OI}, {TT} SELECT {R('(m1-m0)/sqrt(((n1-1)*v1+(n0-1)*v0)/(n1+n0-2)*(1.0/n1+1.0/n0))')} AS t_statistic, (n1+n0-2)::DOUBLE AS dof,
 {R('m1')} AS mean_weekend, {R('m0')} AS mean_weekday FROM s""")
def q_ttest(spark, sf):
    df = items(spark, sf, "days_real", "order_date").withColumn("is_weekend", X.weekend_flag("order_date"))
    return _round(stats.t_test(df), 6, "t_statistic", "mean_weekend", "mean_weekday").drop("p_value")


@query("test_pvalues")
def q_pvalues(spark, sf):
    """Statistic and p-value of all five tests in one table."""
    df = features.add_distance(regional(spark, sf, "order_country", "latitude", "longitude", "days_real", "late_risk", "sales", "order_date"))
    df = df.withColumn("is_weekend", X.weekend_flag("order_date"))
    parts = [
        ("anova_days", stats.anova_oneway(df), "f_statistic"), ("chi2_late", stats.chi_square(df), "chi2"),
        ("kruskal_sales", stats.kruskal_wallis(df), "h_statistic"), ("pearson_distance", stats.pearson_test(df), "r"),
        ("t_weekend", stats.t_test(df), "t_statistic"),
    ]
    out = None
    for name, t, stat in parts:
        row = t.select(F.lit(name).alias("test"), F.col(stat).alias("statistic"), "p_value")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("significant", (F.col("p_value") < 0.05).cast("int"))


# --- Spatial -----------------------------------------------------------------------------

CITY = OI + """, ct AS (SELECT order_city AS id, avg(latitude) AS x, avg(longitude) AS y, avg(late_risk) AS value FROM oi GROUP BY 1),
nb AS (SELECT a.id AS src, b.id AS dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS distance FROM ct a JOIN ct b ON a.id <> b.id),
kn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM nb QUALIFY rank <= 8)"""


def cities(spark, sf):
    from cargolens.session import sized

    return sized(spatial.city_points(items(spark, sf, "order_city", "latitude", "longitude", "late_risk")))


@query("knn_join", f"WITH {CITY} SELECT src, dst, rank::INT AS rank, {R('distance')} AS distance FROM kn")
def q_knn(spark, sf):
    return _round(spatial.knn_join(cities(spark, sf), 8), 6, "distance")


LAG = CITY + """, z AS (SELECT id, (value - avg(value) OVER ())/stddev_pop(value) OVER () AS z FROM ct),
lg AS (SELECT a.id, any_value(a.z) AS z, avg(b.z) AS lag FROM kn JOIN z a ON a.id = kn.src JOIN z b ON b.id = kn.dst GROUP BY 1)"""


@query("spatial_lag", f"""
WITH {LAG} SELECT id, {R('z')} AS z, {R('lag')} AS lag, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM lg""")
def q_lag(spark, sf):
    return _round(spatial.spatial_lag(cities(spark, sf)), 6, "z", "lag")


@query("morans_i", f"WITH {LAG} SELECT count(*)::DOUBLE AS n, {R('sum(z*lag)/sum(z*z)')} AS morans_i, {R('regr_slope(lag, z)')} AS slope FROM lg")
def q_moran(spark, sf):
    return _round(spatial.morans_i(cities(spark, sf)), 6, "morans_i", "slope").drop("p_value")


@query("moran_permutation_p")
def q_moran_p(spark, sf):
    return spatial.moran_permutation(cities(spark, sf))


# --- Residuals ---------------------------------------------------------------------------

RES = SCORED + ", rs AS (SELECT sales AS y, 0.8::DOUBLE*sales + 10000.0::DOUBLE*h AS prediction FROM sc), er AS (SELECT y - prediction AS e FROM rs)"


def residual_rows(spark, sf):
    df = rule_scores(items(spark, sf, *KEYS, "late_risk", "sales"))
    return df.select(F.col("sales").alias("y"), (0.8 * F.col("sales") + 10000.0 * F.col("h")).alias("prediction"))


@query("residual_stats", f"""
WITH {RES}, m AS (SELECT avg(e) AS a, stddev_pop(e) AS s FROM er)
SELECT count(e) AS n, {R('avg(e)', 4)} AS mean, {R('stddev_pop(e)', 4)} AS std, {R('avg(((e-a)/s)^3)')} AS skewness, {R('avg(((e-a)/s)^4) - 3')} AS kurtosis FROM er, m""")
def q_residual(spark, sf):
    return _round(_round(stats.residual_stats(residual_rows(spark, sf)), 4, "mean", "std"), 6, "skewness", "kurtosis")


@query("residual_histogram", f"""
WITH {RES}, m AS (SELECT min(e) AS lo, max(e) AS hi FROM er)
SELECT least(greatest(floor((e-lo)/(hi-lo)*60)::INT, 0), 59)::INT AS bin, count(*) AS count, {R('min(e)', 4)} AS smallest, {R('max(e)', 4)} AS largest FROM er, m GROUP BY 1""")
def q_residual_hist(spark, sf):
    return _round(stats.residual_histogram(residual_rows(spark, sf)), 4, "smallest", "largest")


@query("qq_points", f"""
WITH {RES}, o AS (SELECT e, row_number() OVER (ORDER BY e) AS rank, count(*) OVER () AS n FROM er)
SELECT rank, {R('e', 4)} AS residual, {R('CASE WHEN rank=1 THEN 1-0.5::DOUBLE^(1.0/n) WHEN rank=n THEN 0.5::DOUBLE^(1.0/n) ELSE (rank-0.3175)/(n+0.365) END', 8)} AS p FROM o""")
def q_qq(spark, sf):
    out = stats.qq_points(residual_rows(spark, sf))
    return out.select("rank", X.rnd("residual", 4).alias("residual"), X.rnd("p", 8).alias("p"))


def _horner(parts, x):
    def value(coefficients):
        out = f"{coefficients[-1]!r}::DOUBLE"
        for c in reversed(coefficients[:-1]):
            out = f"({out}*({x})+{c!r}::DOUBLE)"
        return out

    return f"({value(parts[0])}/{value(parts[1])})"


@query("qq_normal_quantiles", f"""
WITH {RES}, o AS (SELECT e, row_number() OVER (ORDER BY e) AS rank, (count(*) OVER ())::DOUBLE AS n FROM er),
pp AS (SELECT rank, e, CASE WHEN rank=1 THEN 1-0.5::DOUBLE^(1.0/n) WHEN rank=n THEN 0.5::DOUBLE^(1.0/n) ELSE (rank-0.3175)/(n+0.365) END AS p FROM o),
qr AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM pp)
SELECT rank, {R('e', 4)} AS residual, {R(f"""CASE WHEN abs(q) <= 0.425 THEN q*{_horner(NORMAL_MIDDLE, '0.180625::DOUBLE-q*q')}
 WHEN r <= 5 THEN sign(q)*{_horner(NORMAL_SIDE, 'r-1.6::DOUBLE')} ELSE sign(q)*{_horner(NORMAL_FAR, 'r-5')} END""")} AS normal_quantile FROM qr""")
def q_qq_normal(spark, sf):
    out = stats.qq_points(residual_rows(spark, sf))
    return out.select("rank", X.rnd("residual", 4).alias("residual"), X.rnd("normal_quantile", 6).alias("normal_quantile"))


@query("iqr_stability", f"""
WITH {OI}, p AS (SELECT order_city AS region, avg(sales) AS mae FROM oi GROUP BY 1),
f AS (SELECT quantile_cont(mae, 0.25) AS q1, quantile_cont(mae, 0.75) AS q3, stddev_samp(mae)/avg(mae) AS cv FROM p)
SELECT region, {R('mae', 3)} AS mae, {R('q1-1.5*(q3-q1)', 3)} AS lower_fence, {R('q3+1.5*(q3-q1)', 3)} AS upper_fence, (mae > q3+1.5*(q3-q1))::INT AS is_outlier,
 {R('cv')} AS cv, CASE WHEN cv > 0.4 THEN 'INCONSISTENT' ELSE 'CONSISTENT' END AS verdict FROM p, f""")
def q_iqr(spark, sf):
    perf = items(spark, sf, "order_city", "sales").groupBy(F.col("order_city").alias("region")).agg(F.avg("sales").alias("mae"))
    return _round(_round(stats.iqr_stability(perf), 3, "mae", "lower_fence", "upper_fence"), 6, "cv")


@query("distribution_shift", f"""
WITH {OI}, b AS (SELECT order_region, CAST(date_trunc('quarter', order_date) AS DATE) AS q, days_real AS v, late_risk FROM oi),
s AS (SELECT order_region, q, count(*) AS n, sum(late_risk) AS a FROM b GROUP BY 1, 2),
p AS (SELECT order_region, q, lag(q) OVER w AS pq, n AS n1, lag(n) OVER w AS n0, a AS a1, lag(a) OVER w AS a0 FROM s WINDOW w AS (PARTITION BY order_region ORDER BY q)),
c AS (SELECT order_region, q, d.v, (SELECT count(*) FROM b WHERE b.order_region = s.order_region AND b.q = s.q AND b.v <= d.v)::DOUBLE/n AS f FROM s, (SELECT DISTINCT v FROM b) d),
k AS (SELECT p.order_region, p.q, max(abs(x.f - y.f)) AS ks FROM p JOIN c x ON x.order_region = p.order_region AND x.q = p.q
 JOIN c y ON y.order_region = p.order_region AND y.q = p.pq AND y.v = x.v GROUP BY 1, 2)
SELECT order_region, q::VARCHAR AS quarter_start, {R('ks')} AS ks_distance,
 {R('(n1+n0)*greatest(abs(a1*(n0-a0)-a0*(n1-a1)) - (n1+n0)/2.0, 0)^2/nullif(((a1+a0)*(n1+n0-a1-a0)*n1*n0)::DOUBLE, 0)', 5)} AS late_chi2 FROM p JOIN k USING (order_region, q)""")
def q_shift(spark, sf):
    out = stats.distribution_shift(items(spark, sf, "order_region", "order_date", "days_real", "late_risk"))
    out = _round(_round(out, 6, "ks_distance"), 5, "late_chi2")
    return out.withColumn("quarter_start", F.col("quarter_start").cast("string"))
