"""Distribution functions in numpy, and Arrow functions of them for columns: t, F, chi-square, normal, binomial."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0, 1)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for even in (True, False):
                num = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) if even else -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def gamma_sf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - _lgamma(a))
        term = total = 1 / a
        for n in range(1, 1000):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            h = h * d * c
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(x, float) for x in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series([None] * len(t), dtype=object)
    out[ok] = t_two_sided(t[ok], df[ok])
    return out


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = f.notna() & (d1 > 0) & (d2 > 0)
    out = pd.Series([None] * len(f), dtype=object)
    out[ok] = f_sf(f[ok], d1[ok], d2[ok])
    return out


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    ok = x.notna() & (df > 0)
    out = pd.Series([None] * len(x), dtype=object)
    out[ok] = chi2_sf(x[ok], df[ok])
    return out


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    ok = z.notna()
    out = pd.Series([None] * len(z), dtype=object)
    out[ok] = normal_two_sided(z[ok])
    return out


def r_p(r, n):
    """Two-sided p of Pearson's or Spearman's r from n pairs."""
    df = n - 2
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p(r * F.sqrt(F.try_divide(df.cast("double"), 1 - r * r)), df.cast("double")))


def binomial_two_sided(k, n):
    """Two-sided exact p of k or more of n at one half: min(1, 2 P(X >= k)), terms by their ratio."""
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(F.lit(1.0).alias("c"), F.when(k <= 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("s")),
                        lambda acc, i: F.struct((acc["c"] * (n - i + 1) / i).alias("c"), (acc["s"] + F.when((i >= k) & (i <= n), acc["c"] * (n - i + 1) / i).otherwise(F.lit(0.0))).alias("s")), lambda acc: acc["s"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * terms / F.pow(F.lit(2.0), n)))
