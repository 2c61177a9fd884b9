"""Distribution functions that the standard library lacks, from published formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution: regularised incomplete gamma, series or continued fraction."""
    if not x > 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = k / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1 - total * front
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def ks_sf(d: float, n: int) -> float:
    """P(D >= d) of the one-sample Kolmogorov-Smirnov statistic: the exact matrix power, or the limit series for large n.

    Below 1e-15 it is the first term of that series.
    """
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 18:
        return 2 * math.exp(-2 * n * d * d)
    if n > 2000:
        t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    H = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    H[:, 0] -= powers
    H[m - 1, :] -= powers[::-1]
    H[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    gap = i - j + 1
    inverse_factorial = np.exp([-math.lgamma(g + 1) for g in range(m + 1)])
    H = np.where(gap > 0, H * inverse_factorial[np.maximum(gap, 0)], H)
    Q, scale, e = np.eye(m), 0, n
    base, bscale = H, 0
    while e:
        if e & 1:
            Q, scale = Q @ base, scale + bscale
            if Q[k - 1, k - 1] > 1e140:
                Q, scale = Q * 1e-140, scale + 140
        base, bscale = base @ base, 2 * bscale
        if base[k - 1, k - 1] > 1e140:
            base, bscale = base * 1e-140, bscale + 140
        e >>= 1
    s = Q[k - 1, k - 1]
    for x in range(1, n + 1):
        s *= x / n
        if s < 1e-140:
            s, scale = s * 1e140, scale - 140
    return min(1.0, max(0.0, 1 - s * 10.0**scale))


def chi2_tail(x: Column, k: Column) -> Column:
    """`chi2_sf` of columns, in Arrow batches; null where either is null. For rows of test statistics."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return tail(x, k)


def ks_tail(d: Column, n: Column) -> Column:
    """`ks_sf` of columns, in Arrow batches; null where either is null. For rows of test statistics."""

    @F.pandas_udf("double")
    def tail(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else ks_sf(float(a), int(b)) for a, b in zip(d, n, strict=True)], dtype="float64")

    return tail(d, n)
