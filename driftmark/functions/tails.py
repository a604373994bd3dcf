"""Tail probabilities for small result tables, as Arrow-batched functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p(value: float, d1: float, d2: float) -> float:
    """Upper tail of F."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * value)) if value > 0 else 1.0


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the tables with the same margins that are at most as likely."""
    n, row, col = a + b + c + d, a + b, a + c
    log = lambda x: (
        math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1)
        + math.lgamma(col + 1) + math.lgamma(n - col + 1) - math.lgamma(n + 1)
    )
    own = log(a) + 1e-7
    return min(1.0, sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := log(x)) <= own))


@lru_cache(maxsize=256)
def rank_sum_counts(m: int, n: int) -> list[int]:
    """Number of ways in which m of m + n untied values give each U, from 0 to m * n."""
    ways = {(0, 0): [1]}
    for i in range(m + 1):
        for j in range(n + 1):
            if (i, j) == (0, 0):
                continue
            out = [0] * (i * j + 1)
            if i:
                for u, w in enumerate(ways[i - 1, j]):
                    out[u + j] += w
            if j:
                for u, w in enumerate(ways[i, j - 1]):
                    out[u] += w
            ways[i, j] = out
    return ways[m, n]


def rank_sum_exact_p(u: float, m: int, n: int) -> float:
    """Two-sided exact p of the Mann-Whitney U of untied samples."""
    counts = rank_sum_counts(m, n)
    low = min(u, m * n - u)
    return min(1.0, 2 * sum(counts[: int(low) + 1]) / sum(counts))


def signed_rank_exact_p(w: float, n: int) -> float:
    """Two-sided exact p of Wilcoxon's signed rank sum of n untied differences."""
    counts = [1]
    for r in range(1, n + 1):
        new = counts + [0] * r
        for s, k in enumerate(counts):
            new[s + r] += k
        counts = new
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * sum(counts[: int(low) + 1]) / 2**n)


def _each(f, *columns: pd.Series) -> pd.Series:
    ok = np.all([c.notna().to_numpy() for c in columns], axis=0)
    return pd.Series([f(*v) if good else None for good, *v in zip(ok, *columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: t_p(a, b) if b > 0 else None, t, df)


@F.pandas_udf(DoubleType())
def f_upper(value: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: f_p(a, b, c) if b > 0 and c > 0 else None, value, d1, d2)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(lambda *x: fisher_p(*map(int, x)), a, b, c, d)


@F.pandas_udf(DoubleType())
def mann_whitney_exact(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda x, y, z: rank_sum_exact_p(x, int(y), int(z)), u, m, n)


@F.pandas_udf(DoubleType())
def signed_rank_exact(w: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda x, y: signed_rank_exact_p(x, int(y)), w, n)
