"""Tail probabilities that Spark has no built-in for, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|)."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else np.nan)


def _beta_fraction(a: float, b: float, x: float) -> float:
    # continued fraction of the incomplete beta function (modified Lentz)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for i in range(1, 300):
        for num in (
            i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
            -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def f_cdf(value: float, dof: float) -> float:
    """P(F <= value) for equal degrees of freedom ``dof``."""
    if not value > 0:
        return 0.0 if value == value else float("nan")
    a = dof / 2.0
    x = value / (1.0 + value)
    front = math.exp(math.lgamma(2 * a) - 2 * math.lgamma(a) + a * math.log(x) + a * math.log1p(-x))
    if x < 0.5:
        return front * _beta_fraction(a, a, x) / a
    return 1.0 - front * _beta_fraction(a, a, 1.0 - x) / a


@F.pandas_udf(T.DoubleType())
def f_two_sided(value: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a variance ratio with equal degrees of freedom."""

    def one(v, k):
        if v != v or k != k or k < 1:
            return np.nan
        p = f_cdf(v, k)
        return min(1.0, 2.0 * min(p, 1.0 - p))

    return pd.Series([one(v, k) for v, k in zip(value, dof)])
