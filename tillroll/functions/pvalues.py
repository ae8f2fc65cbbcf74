"""Two-sided p-values as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f, x):
    x = np.asarray(x, dtype=float)
    return np.array([f(v) for v in x.ravel()], dtype=float).reshape(x.shape)


# Lanczos' coefficients for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def _log_gamma(x):
    """Of whole arrays of numbers of at least 0.5."""
    x = np.asarray(x, dtype=float) - 1.0
    series = _LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(_LANCZOS) if i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def _erfc(x):
    return _each(math.erfc, x)


def _beta_fraction(x, a, b, steps: int = 500):
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            out = out * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return out


def regularized_beta(x, a, b):
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    xs, p, q = np.where(swap, 1.0 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            p * np.log(xs) + q * np.log1p(-xs) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)
        )
        part = np.where(xs > 0, front * _beta_fraction(xs, p, q) / p, 0.0)
    return np.where(swap, 1.0 - part, part)


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return regularized_beta(df / (df + t * t), df / 2.0, 0.5)


def normal_two_sided(z):
    return np.minimum(1.0, _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0)))


def t_pvalue(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        known = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        out[known] = t_two_sided(t[known], df[known])
        return out

    return F.nanvl(p(t, df.cast("double")), F.lit(None))


def upper_normal_pvalue(z: Column) -> Column:
    """min(1, 2 * P(Z > z)): a z below zero gives 1."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(1.0, _erfc(z.to_numpy(dtype=float) / math.sqrt(2.0))))

    return F.nanvl(p(z), F.lit(None))
