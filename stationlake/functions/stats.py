"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(population_skew: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from g1; NULL below three values."""
    return F.when(n > 2, F.try_divide(population_skew * F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(population_excess: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from g2; NULL below four values."""
    return F.when(
        n > 3, F.try_divide((n - 1) * ((n + 1) * population_excess + 6), (n - 2) * (n - 3))
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; NULL for a constant column.

    Composed of aggregates because ``corr`` raises on a constant column in ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(a, b), spread))


def jarque_bera(skew: Column, excess: Column, n: Column) -> Column:
    return n / 6 * (skew * skew + excess * excess / 4)


def jarque_bera_p(statistic: Column) -> Column:
    """Upper tail of a chi-square with two degrees of freedom."""
    return F.exp(-statistic / 2)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


# Rational approximation 26.2.23 of Abramowitz and Stegun.
NUMERATOR = [2.515517, 0.802853, 0.010328]
DENOMINATOR = [1.0, 1.432788, 0.189269, 0.001308]


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile, absolute error below 4.5e-4."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    top = NUMERATOR[0] + t * (NUMERATOR[1] + t * NUMERATOR[2])
    bottom = DENOMINATOR[0] + t * (
        DENOMINATOR[1] + t * (DENOMINATOR[2] + t * DENOMINATOR[3])
    )
    z = t - top / bottom
    return F.when(p < 0.5, -z).otherwise(z)
