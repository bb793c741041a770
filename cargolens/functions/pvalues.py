"""Tail probabilities of the F, chi-square and t distributions.

They finish a one-row test result, so they run as Arrow-batched column functions on that row.
The statistics themselves are computed by Spark aggregations. The normal quantile, which is taken of whole
columns, is an expression.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz evaluation)."""
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def _guarded(fn, *args):
    return None if any(a is None or a != a for a in args) else float(fn(*args))


@F.pandas_udf(T.DoubleType())
def f_pvalue(stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    tail = lambda f, d1, d2: beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
    return pd.Series([_guarded(tail, *row) for row in zip(stat, df1, df2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    tail = lambda x, k: gamma_tail(k / 2.0, x / 2.0)
    return pd.Series([_guarded(tail, *row) for row in zip(stat, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided."""
    tail = lambda t, k: beta_cdf(k / 2.0, 0.5, k / (k + t * t))
    return pd.Series([_guarded(tail, *row) for row in zip(stat, dof)], dtype="float64")


# Coefficients of the published rational approximations of the normal quantile (Wichura 1988, algorithm
# AS 241), constant term first: in the middle, up to 5 beyond it, and farther out.
NORMAL_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
     4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3),
    (1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
     2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3))
NORMAL_SIDE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
NORMAL_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _ratio(parts: tuple, x: Column) -> Column:
    def value(coefficients: tuple) -> Column:
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * x + c
        return out

    return value(parts[0]) / value(parts[1])


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile as a column expression; null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    side = F.when(r <= 5, _ratio(NORMAL_SIDE, r - 1.6)).otherwise(_ratio(NORMAL_FAR, r - 5))
    found = F.when(F.abs(q) <= 0.425, q * _ratio(NORMAL_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * side)
    return F.when((p > 0) & (p < 1), found)
