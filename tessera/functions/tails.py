"""Tail probabilities as Arrow-batched functions, without any statistics package."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        swap = x > (a + 1) / (a + b + 2)
        out = np.where(swap, 1 - front * _beta_fraction(b, a, 1 - x) / b, front * _beta_fraction(a, b, x) / a)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: the chance of at least ``a`` events where ``x`` are expected."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
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
    return 1 - front * h


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def binomial_upper(k, n, p) -> np.ndarray:
    """Chance of at least ``k`` of ``n``."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = np.clip(k, 1e-9, np.maximum(n, 1e-9))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, beta_inc(inside, n - inside + 1, p)))


def log_hypergeometric_upper(k: int, marked: int, unmarked: int, drawn: int) -> float:
    """Natural logarithm of the chance of at least ``k`` marked among ``drawn``."""
    low, high = max(k, drawn - unmarked, 0), min(marked, drawn)
    if low > high:
        return -math.inf
    if low == max(0, drawn - unmarked):
        return 0.0
    i = np.arange(low, high + 1, dtype=float)
    choose = lambda n, r: math.lgamma(n + 1) - _lgamma(r + 1) - _lgamma(n - r + 1)
    terms = choose(marked, i) + choose(unmarked, drawn - i) - float(choose(marked + unmarked, np.array(float(drawn))))
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t or df is."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, t.index)
    out[ok] = t_two_sided(t[ok], df[ok])
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.notna(), normal_two_sided(z.fillna(0)), np.nan), z.index)


@F.pandas_udf(DoubleType())
def poisson_upper_p(k: pd.Series, mean: pd.Series) -> pd.Series:
    """Chance of at least ``k`` events."""
    return pd.Series([1.0 if a <= 0 else gamma_lower(a, m) for a, m in zip(k, mean)], k.index)


@F.pandas_udf(DoubleType())
def binomial_upper_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_upper(k, n, p), k.index)


@F.pandas_udf(DoubleType())
def hypergeometric_mlog10p(k: pd.Series, marked: pd.Series, unmarked: pd.Series, drawn: pd.Series) -> pd.Series:
    """Minus the decimal logarithm of the upper tail."""
    return pd.Series([-log_hypergeometric_upper(int(a), int(b), int(c), int(d)) / math.log(10) for a, b, c, d in zip(k, marked, unmarked, drawn)], k.index)
