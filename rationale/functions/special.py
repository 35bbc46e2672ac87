"""Special functions from expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def kernel(distance, width) -> Column:
    """Root of exp(-d^2 / w^2)."""
    d, w = _c(distance), _c(width)
    return F.sqrt(F.exp(-(d * d) / (w * w)))


def bernoulli_kl(p, q) -> Column:
    p, q = (F.least(F.greatest(_c(x), F.lit(1e-7)), F.lit(1 - 1e-7)) for x in (p, q))
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.clip(p, 1e-7, 1 - 1e-7), np.clip(q, 1e-7, 1 - 1e-7)
    return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))


def kl_bounds(p: np.ndarray, level: np.ndarray, upper: bool, steps: int = 16) -> np.ndarray:
    lo, hi = (p, np.minimum(p + np.sqrt(level / 2), 1.0)) if upper else (np.maximum(p - np.sqrt(level / 2), 0.0), p)
    for _ in range(steps):
        middle = (lo + hi) / 2
        beyond = _divergence(p, middle) > level
        lo, hi = (np.where(beyond, lo, middle), np.where(beyond, middle, hi)) if upper else (np.where(beyond, middle, lo), np.where(beyond, hi, middle))
    return hi if upper else lo


def kl_bound(p, level, upper: bool, steps: int = 16) -> Column:
    """Largest (or least) q whose divergence from p stays within ``level``, by bisection of a batch at once."""

    @F.pandas_udf(DoubleType())
    def halved(p: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series(kl_bounds(p.to_numpy(float), level.to_numpy(float), upper, steps))

    return halved(_c(p).cast("double"), _c(level).cast("double"))


def exploration_rate(n_features: int, t: int, delta: float) -> float:
    """Confidence level that grows with rounds."""
    return math.log(405.5 * n_features * t**1.1 / delta) + math.log(math.log(405.5 * n_features * t**1.1 / delta))


def log_factorial(n) -> Column:
    """ln n! by Stirling's series for n + 9, less the logs of the factors above n; relative error below 1e-13."""
    x = _c(n).cast("double")
    z = x + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    above = (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * (x + 8)
    return series - F.log(above)


def log_binomial(n, k) -> Column:
    """ln of n over k."""
    return log_factorial(n) - log_factorial(k) - log_factorial(_c(n) - _c(k))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function (rational approximation, error below 1e-7)."""
    # fixed values of the approximation
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_quantiles(u: np.ndarray) -> np.ndarray:
    """Inverse of ``normal_cdf``, by 40 halvings of [-8, 8]."""
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    lo, hi = np.full(u.shape, -8.0), np.full(u.shape, 8.0)
    for _ in range(40):
        middle = (lo + hi) / 2
        t = 1 / (1 + p * np.abs(middle))
        tail = np.exp(-middle * middle / 2) / math.sqrt(2 * math.pi) * t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
        low = np.where(middle >= 0, 1 - tail, tail) < u
        lo, hi = np.where(low, middle, lo), np.where(low, hi, middle)
    return np.where(np.isnan(u), np.nan, (lo + hi) / 2)


@F.pandas_udf(DoubleType())
def _quantiles(u: pd.Series) -> pd.Series:
    return pd.Series(normal_quantiles(u.to_numpy(float)))


def inverse_normal(u: Column) -> Column:
    """Inverse of the normal distribution function, a batch at once: as an expression, each halving would be interpreted."""
    return _quantiles(u)


def truncated_normal(u: Column, mean, std, lo, hi) -> Column:
    mean, std, lo, hi = map(_c, (mean, std, lo, hi))
    a, b = normal_cdf((lo - mean) / std), normal_cdf((hi - mean) / std)
    return F.least(F.greatest(mean + std * inverse_normal(a + u * (b - a)), lo), hi)


def _t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or t != t:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0:
        return 0.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300))) / a
    value = 1.0
    for m in range(200, 0, -1):
        k = m // 2
        term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = 1 + term / value
    p = front / value
    return 1 - p if swap else p


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_t_tail(abs(a), b) for a, b in zip(t, df, strict=True)])
