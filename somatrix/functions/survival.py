"""Upper tails of distributions, as vectorised functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: by series below a + 1, by continued fraction above."""
    if not (x >= 0 and a > 0):
        return math.nan
    if x == 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_survival(x: str, df: str) -> Column:
    """P(X > x) of a chi-square distribution; null where x is null."""

    @F.pandas_udf("double")
    def survival(values: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(v) else upper_gamma(k / 2, v / 2) for v, k in zip(values.astype(float), freedom, strict=True)], dtype="float64")

    return F.when(F.col(x).isNotNull(), survival(x, df))


def normal_survival(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""

    @F.pandas_udf("double")
    def survival(values: pd.Series) -> pd.Series:
        return values.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))

    return F.when(z.isNotNull(), survival(z))
