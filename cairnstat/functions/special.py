"""Probability tails on the natural-log scale, in numpy, and the same as Arrow UDFs.

Arguments are arrays; NaN stands for a missing value and gives NaN, which the
UDFs turn into NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

LN2 = math.log(2.0)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _f(x) -> np.ndarray:
    return np.asarray(x, dtype=np.float64)


def lgamma(x) -> np.ndarray:
    return np.asarray(_lgamma(_f(x)), dtype=np.float64)


def log1mexp(x: np.ndarray) -> np.ndarray:
    """ln(1 - e^x) for x <= 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > -LN2, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def log_normal_tail(z) -> np.ndarray:
    """ln P(Z >= z) of a standard normal variable."""
    z = _f(z)
    near = np.clip(z, -38.0, 30.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(0.5 * np.asarray(_erfc(near / math.sqrt(2.0)), dtype=np.float64))
        far = np.maximum(z, 30.0)
        i = 1.0 / far**2
        tail = -0.5 * far**2 - np.log(far) - 0.5 * math.log(2 * math.pi) + np.log1p(i * (-1.0 + i * (3.0 - 15.0 * i)))
    return np.where(np.isnan(z), np.nan, np.where(z > 30.0, tail, np.where(z < -38.0, 0.0, out)))


def normal_quantile_from_log(lp) -> np.ndarray:
    """z with P(Z <= z) = e^lp; lp 0 gives infinity, -infinity gives -infinity."""
    lp = _f(lp)
    upper = lp > -LN2
    small = np.where(upper, log1mexp(np.minimum(lp, -1e-320)), lp)  # log of the smaller tail
    small = np.where(np.isnan(lp), np.nan, np.where(lp >= 0, -np.inf, small))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(np.maximum(-2.0 * small, 1e-300))
        z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1.0 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
        z = np.where(t > 50, np.sqrt(np.maximum(t**2 - np.log(2 * math.pi * np.maximum(t, 1) ** 2), 0)), z)
        for _ in range(6):  # Newton on the log tail
            lt = log_normal_tail(z)
            density = -0.5 * z**2 - 0.5 * math.log(2 * math.pi)
            z = z + (lt - small) * np.exp(np.clip(lt - density, -700, 700))
    z = np.where(np.isneginf(small), np.inf, z)
    return np.where(np.isnan(lp), np.nan, np.where(upper, z, -z))


def log_beta_cdf(x, a, b) -> np.ndarray:
    """ln I_x(a, b), the regularised incomplete beta function, by a continued fraction (modified Lentz)."""
    x, a, b = np.broadcast_arrays(_f(x), _f(a), _f(b))
    bad = np.isnan(x) | np.isnan(a) | np.isnan(b)
    x, a, b = np.where(bad, 0.5, np.clip(x, 0.0, 1.0)), np.where(bad, 1.0, a), np.where(bad, 1.0, b)
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx) - np.log(aa)
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1.0 - (aa + bb) * xx / (aa + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 1000):
            num = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
            d, c = 1.0 + num * d, 1.0 + num / c
            d, c = 1.0 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            num = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
            d, c = 1.0 + num * d, 1.0 + num / c
            d, c = 1.0 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        lo = np.minimum(front + np.log(h), 0.0)
    lo = np.where(xx <= 0.0, -np.inf, lo)
    return np.where(bad, np.nan, np.where(swap, log1mexp(lo), lo))


def log_t_tail(t, df) -> np.ndarray:
    """ln P(T >= t) of Student's t."""
    t, df = np.broadcast_arrays(_f(t), _f(df))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        half = -LN2 + log_beta_cdf(df / (df + t * t), df / 2.0, 0.5)
    half = np.where(np.isinf(t), -np.inf, half)
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.where(t > 0, half, log1mexp(half)))


def log_f_tail(f, d1, d2) -> np.ndarray:
    """ln P(F >= f)."""
    f, d1, d2 = np.broadcast_arrays(_f(f), _f(d1), _f(d2))
    with np.errstate(invalid="ignore"):
        return np.where(f <= 0, np.where(np.isnan(f), np.nan, 0.0), log_beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0))


def log_binomial_tails(k, n, p) -> tuple[np.ndarray, np.ndarray]:
    """ln P(X <= k) and ln P(X >= k); both 0 when n is 0."""
    k, n, p = np.broadcast_arrays(_f(k), _f(n), _f(p))
    lower = np.where(k >= n, 0.0, log_beta_cdf(1.0 - p, np.maximum(n - k, 1e-9), k + 1.0))
    upper = np.where(k <= 0, 0.0, log_beta_cdf(p, np.maximum(k, 1e-9), n - k + 1.0))
    bad = np.isnan(k) | np.isnan(n) | np.isnan(p)
    return np.where(bad, np.nan, lower), np.where(bad, np.nan, upper)


def log_chi_square_tail_even(x, dof: int) -> np.ndarray:
    """ln P(X >= x) for an even number of degrees of freedom."""
    y, total, term = _f(x) / 2.0, 0.0, 1.0
    for j in range(dof // 2):
        term = 1.0 if j == 0 else term * y / j
        total = total + term
    return -y + np.log(total)


def stouffer_log(lp, weights=None) -> float:
    """ln of the combined one-sided p-value; NaN if opposite infinities meet or nothing is left."""
    lp = _f(lp)
    w = np.ones_like(lp) if weights is None else _f(weights)
    ok = ~np.isnan(lp) & (w > 0)
    if not ok.any():
        return float("nan")
    z = -normal_quantile_from_log(lp[ok])
    if np.isposinf(z).any() and np.isneginf(z).any():
        return float("nan")
    return float(log_normal_tail(np.array([(w[ok] * z).sum() / math.sqrt((w[ok] ** 2).sum())]))[0])


def _out(x: np.ndarray) -> pd.Series:
    return pd.Series(x).where(~np.isnan(x), None)


@F.pandas_udf(T.DoubleType())
def normal_tail_udf(z: pd.Series) -> pd.Series:
    return _out(log_normal_tail(z))


@F.pandas_udf(T.DoubleType())
def t_tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _out(log_t_tail(t, df))


@F.pandas_udf(T.DoubleType())
def f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _out(log_f_tail(f, d1, d2))


@F.pandas_udf(T.StructType([T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType())]))
def binomial_tails_udf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
    left, right = log_binomial_tails(k, n, p)
    return pd.DataFrame({"left": _out(left), "right": _out(right)})


@F.pandas_udf(T.DoubleType())
def quantile_log_udf(lp: pd.Series) -> pd.Series:
    return _out(normal_quantile_from_log(lp))
