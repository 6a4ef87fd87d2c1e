"""Distribution functions as column expressions, evaluated without Python workers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

NORMAL_REACH = 6.0  # beyond it the normal distribution function is within 1e-9 of 0 or 1
NORMAL_TERMS = 61


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to 1e-9: 1/2 + phi(z) (z + z^3/3 + z^5/(3 5) + ...).

    All terms have one sign, so nothing cancels. NULL stays NULL.
    """
    near = F.greatest(F.least(z, F.lit(NORMAL_REACH)), F.lit(-NORMAL_REACH))
    odd = F.sequence(F.lit(2 * NORMAL_TERMS + 1), F.lit(3), F.lit(-2))
    series = F.aggregate(odd, F.lit(1.0), lambda total, k: total * near * near / k + 1.0)
    cdf = F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * near * series + 0.5
    return F.when(z.isNotNull(), cdf)


def kolmogorov_upper(x: Column) -> Column:
    """P(K > x) of Kolmogorov's limit distribution, for x above 0: the quicker of its two series."""
    low = sum((F.exp(-((2 * j - 1) * math.pi) ** 2 / (8 * x * x)) for j in range(1, 5)), F.lit(0.0))
    high = sum((F.exp(-2.0 * j * j * x * x) * (1.0 if j % 2 else -1.0) for j in range(1, 7)), F.lit(0.0))
    return F.when(x < 1, 1 - math.sqrt(2 * math.pi) / x * low).otherwise(2 * high)
