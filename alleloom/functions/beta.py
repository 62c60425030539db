"""The regularised incomplete beta function, by Lentz's continued fraction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if math.isnan(x) or a <= 0 or b <= 0:
        return math.nan
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + n * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + n / (c if abs(c) > tiny else tiny)
        step = c * d
        f *= step
        if abs(1 - step) < 1e-15:
            break
    return front * (f - 1)


def p_value(r: float | None, v: float | None, n: float | None) -> float | None:
    """P-value of a ratio r in 0..1 with variance v: a beta law centred at one half; NaN without data, null if undefined."""
    if not n:
        return math.nan
    if r is None:
        return None
    if r >= 1 or r <= 0:  # whatever the variance
        return 0.0
    if v is None or math.isnan(v) or v >= 0.25:
        return None
    if v <= 0:
        return 0.0
    a = 1 / (8 * v) - 0.5
    return incomplete_beta(min(r, 1 - r), a, a)


@F.pandas_udf(T.DoubleType())
def p_value_udf(r: pd.Series, v: pd.Series, n: pd.Series) -> pd.Series:
    clean = lambda x: None if x is None or x != x else x
    return pd.Series([p_value(clean(a), clean(b), clean(c)) for a, b, c in zip(r, v, n, strict=True)], dtype="float64")
