"""Quantiles and tails of the chi-square and Kolmogorov distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Degrees of freedom from which the cube root of a chi-square is taken for normal; its error is below 1e-6 there.
MANY_DEGREES = 1_000


def chi2_sf(x: float, df: int) -> float:
    """Upper tail for whole degrees of freedom: finite sums over the incomplete gamma recurrence."""
    if x <= 0:
        return 1.0
    if df >= MANY_DEGREES:
        k = 2 / (9 * df)
        return math.erfc(((x / df) ** (1 / 3) - 1 + k) / math.sqrt(2 * k)) / 2
    h = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
        a = 1.5
    else:
        total, term = math.exp(-h), math.exp(-h) * h
        a = 2.0
    for _ in range((df - 1) // 2):
        total += term
        term *= h / a
        a += 1
    return min(1.0, total)


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def kolmogorov_exact_sf(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples of ``n`` and ``m`` values without ties, by lattice paths.

    A path of n steps right and m steps up is an order of both samples; D stays
    below d where |i / n - j / m| < d at every point.  The share of the paths to
    (i, j) that stay inside is the mean of the shares at (i - 1, j) and (i, j - 1),
    weighted i to j; points of one diagonal are taken at once.
    """
    # D is a multiple of 1 / (n m): compare with the middle between two of them.
    bound = math.floor(d * n * m + 1e-7) - 0.5
    if bound < 0:
        return 1.0
    share = np.ones(1)  # of the points i = first, first + 1, ... of a diagonal
    first = 0
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(n, k)
        i = np.arange(low, high + 1, dtype=np.int64)
        padded = np.zeros(high - low + 3)
        padded[first - low + 1 : first - low + 1 + len(share)] = share  # place of i is i - low + 1
        share = np.where(np.abs(i * m - (k - i) * n) <= bound, (i * padded[:-2] + (k - i) * padded[1:-1]) / k, 0.0)
        first = low
    return float(min(1.0, max(0.0, 1 - share[0])))


def _quantile(sf, q: float) -> float:
    lo, hi = 0.0, 1.0
    while sf(hi) > 1 - q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sf(mid) > 1 - q else (lo, mid)
    return (lo + hi) / 2


def chi2_ppf(q: float, df: int) -> float:
    return _quantile(lambda x: chi2_sf(x, df), q) if df > 0 else 0.0


def kolmogorov_ppf(q: float) -> float:
    return _quantile(kolmogorov_sf, q)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Chi-square p-value, for rows that are already aggregated."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else chi2_sf(a, int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_quantile(q: pd.Series, df: pd.Series) -> pd.Series:
    known = {(a, int(b)): chi2_ppf(a, int(b)) for a, b in set(zip(q, df, strict=True)) if not pd.isna(b)}
    return pd.Series([None if pd.isna(b) else known[a, int(b)] for a, b in zip(q, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _kolmogorov_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else kolmogorov_exact_sf(x, int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], dtype="float64")


def kolmogorov_p(d: Column, n: Column, m: Column, exact_up_to: int) -> Column:
    """Two-sample p-value of ``d``: exact if neither sample has more than ``exact_up_to`` values, else asymptotic.  For aggregated rows."""
    small = (F.greatest(n, m) <= exact_up_to) & (F.least(n, m) > 0)
    if exact_up_to <= 0:
        return kolmogorov_tail(d, n, m)
    return F.when(small, _kolmogorov_exact(F.when(small, d), n, m)).otherwise(kolmogorov_tail(d, n, m))


def kolmogorov_tail(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample p-value of ``d``, in native expressions."""
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
