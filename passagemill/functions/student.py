"""Student's t distribution from the incomplete beta function's continued fraction (public formulas)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection and Newton-free halving to the last bit."""
    low, high = -1e3, 1e3
    while 1 - t_upper_tail(high, df) < p:
        high *= 10
    while 1 - t_upper_tail(low, df) > p:
        low *= 10
    for _ in range(200):
        mid = (low + high) / 2
        if t_upper_tail(mid, df) > 1 - p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else t_upper_tail(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict[tuple[float, float], float] = {}
    return pd.Series([None if pd.isna(b) or b < 1 else known.setdefault((a, b), t_quantile(float(a), float(b))) for a, b in zip(p, df, strict=True)], dtype="float64")
