"""Student's t distribution, which Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_tail(t: float, df: float) -> float:
    """P(T > t), by the continued fraction of the incomplete beta function."""
    if t != t or df != df or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    a, b, x = df / 2.0, 0.5, df / (df + t * t)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        out = d
        for m in range(1, 300):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + term * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + term / (c if abs(c) > 1e-300 else 1e-300)
                out *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        two = 1.0
    elif x < (a + 1) / (a + b + 2):
        two = front * fraction(a, b, x) / a
    else:
        two = 1.0 - front * fraction(b, a, 1 - x) / b
    return two / 2 if t >= 0 else 1 - two / 2


@F.pandas_udf(T.DoubleType())
def upper_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.array([_upper_tail(a, b) for a, b in zip(t.astype(float), df.astype(float))]))
