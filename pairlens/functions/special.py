"""Two-sided p-value of a Pearson correlation, evaluated on aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta function of ({a}, {b}) did not converge at {x}")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# Beyond so many points the normal approximation below is exact to double precision.
MANY = 100_000


def pearson_p(r: float, n: float) -> float:
    """Two-sided p-value of correlation r over n points (t test with n - 2 degrees).

    Everything is formed from r squared, never from 1 minus its complement. For many points the t
    variable is turned into a normal one by Hill's expansion.
    """
    if r is None or n is None or math.isnan(r) or n < 2:
        return float("nan")
    if n == 2 or r == 0:
        return 1.0
    r = min(abs(r), 1.0)
    if r == 1.0:
        return 0.0
    if n > MANY:
        free = n - 2.5
        z = math.sqrt(-free * math.log1p(-r * r))
        return math.erfc((z + (z**3 + 3 * z) / (48 * free * free)) / math.sqrt(2))
    a = n / 2.0 - 1.0
    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * math.log1p(-r * r) + math.log(r))
    rest = (1.0 - r) * (1.0 + r)
    if rest < (a + 1.0) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, rest) / a
    return 1.0 - front * _beta_fraction(0.5, a, r * r) / 0.5


def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p(x, k) for x, k in zip(r, n)], dtype=np.float64)


def pearson_p_value(r: Column, n: Column) -> Column:
    return F.pandas_udf(_p_values, "double")(r.cast("double"), n.cast("double"))
