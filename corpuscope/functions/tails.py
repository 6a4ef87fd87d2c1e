"""Upper tails of the t and chi-squared distributions for report rows.

Small numeric helpers on a handful of statistics, not on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


NORMAL_FROM = 1e6  # degrees of freedom; beyond, the next term of the expansion is below 1e-11


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return result
    raise ArithmeticError(f"no convergence at a={a}, b={b}, x={x}")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > NORMAL_FROM:
        # The normal tail with the first term of its expansion in 1/df.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * df)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail Q(df/2, x/2) of the chi-squared distribution."""
    if df <= 0 or math.isnan(x):
        return math.nan
    a, z = df / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    result = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return scale * result
    raise ArithmeticError(f"no convergence at x={x}, df={df}")


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation by the t approximation with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _pairwise(fn):
    @F.pandas_udf("double")
    def column(first: pd.Series, second: pd.Series) -> pd.Series:
        values = [fn(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(first, second)]
        return pd.Series(values, dtype="float64")

    return column


def correlation_p_column():
    return _pairwise(correlation_p)


def chi2_upper_column():
    return _pairwise(chi2_upper)
