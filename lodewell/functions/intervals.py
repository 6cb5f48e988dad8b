"""Exact intervals and tail probabilities that Spark has no function for (Arrow batches)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def exact_bounds(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson; (0, 1) where nothing was counted."""
    if n <= 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    return (0.0 if k <= 0 else beta_quantile(tail, k, n - k + 1)), (1.0 if k >= n else beta_quantile(1 - tail, k + 1, n - k))


@F.pandas_udf(StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_bounds(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series([np.nan if not np.isfinite(x) or v <= 0 else beta_cdf(v / 2, 0.5, v / (v + x * x)) for x, v in zip(t, df, strict=True)])


def with_interval(df, k: str, n: str):
    """`df` with lo and hi of the exact interval of k out of n."""
    return df.withColumn("_ci", clopper_pearson(F.col(k), F.col(n))).withColumn("lo", F.col("_ci.lo")).withColumn("hi", F.col("_ci.hi")).drop("_ci")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
