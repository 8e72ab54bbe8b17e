"""Poisson means, headroom and two-sided p-values of any number of units, as columns.

Means and headroom are built-in expressions.  P-values are vectorised over Arrow batches: the tail on the count's own
side is summed outward from the probability at the count, which is taken by its saddle-point form in logarithms, so tiny
tails keep their digits; the other tail follows from it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

P_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("eps", T.DoubleType())])


def _double(x: Column | str | float) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def expected_collisions_of(points: Column | str, cells: Column | str | float) -> Column:
    """Mean number of collisions of ``points`` balls in ``cells`` urns; neither of its two brackets loses digits."""
    n, c = _double(points), _double(cells)
    y = n * F.log1p(-1 / c)
    series = F.lit(1.0)
    for k in range(19, 2, -1):  # 1 + y/3 (1 + y/4 (...)), times y^2/2
        series = 1 + series * y / k
    rest = F.when(F.abs(y) > 0.5, F.expm1(y) - y).otherwise(series * y * y / 2)
    inverse = F.lit(0.0)
    for k in range(11, 0, -1):  # 1/(2 c) + 1/(3 c^2) + ...
        inverse = (inverse + 1 / (k + 1)) / c
    log_rest = F.when(c < 50, 1 + c * F.log1p(-1 / c)).otherwise(-inverse)
    return F.when(n <= 1, 0.0).when(c <= 1, n - c).otherwise(c * rest + n * log_rest)


def birthday_mean_of(points: Column | str, cells: Column | str | float) -> Column:
    """Mean number of equal spacings: points^3 / (4 cells)."""
    n = _double(points)
    return n * n * n / (4 * _double(cells))


def headroom_of(points: Column | str, bits: Column | str | float) -> Column:
    """A load that none of 2^bits equal bins exceeds but with probability below 10^-1000 (Bernstein's bound)."""
    n, b = _double(points), _double(bits)
    mean, log = n / F.pow(F.lit(2.0), b), b * math.log(2) + 1000 * math.log(10)
    bound = F.ceil(mean + log / 3 + F.sqrt(log * log / 9 + 2 * mean * log))
    whole = (F.col(points) if isinstance(points, str) else points).cast("long")
    return F.when(b == 0, whole).otherwise(F.least(whole, bound.cast("long")))


_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) minus Stirling's approximation, n >= 1."""
    s = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / s) / s) / s) / s) / n
    return np.where(n <= 15, _SMALL[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x/mean) + mean - x; where the two are close, by a series that does not cancel."""
    out = x * np.log(x / mean) + mean - x
    near = np.flatnonzero(np.abs(x - mean) < 0.1 * (x + mean))
    v = (x[near] - mean[near]) / (x[near] + mean[near])
    total, term = (x[near] - mean[near]) * v, 2 * x[near] * v
    for i in range(1, 30):  # |v| < 0.1
        term = term * v * v
        total = total + term / (2 * i + 1)
    out[near] = total
    return out


def _log_probability(count: np.ndarray, mean: np.ndarray) -> np.ndarray:
    n = np.maximum(count, 1)
    return np.where(count == 0, -mean, -_stirling_error(n) - _deviance(n, mean) - 0.5 * np.log(2 * np.pi * n))


def _tails(count: np.ndarray, mean: np.ndarray, upward: bool) -> np.ndarray:
    """Sums of the probabilities from each count outward."""
    total = np.ones(len(count))
    at, k, term, m, own = np.arange(len(count)), count.copy(), np.ones(len(count)), mean, np.ones(len(count))
    while len(at):
        if upward:
            k = k + 1
            term = term * (m / k)
        else:
            term = term * (k / m)
            k = k - 1
        own = own + term
        go = (term >= own * 1e-18) & (term > 0) if upward else (term >= own * 1e-18) & (k > 0) & (term > 0)
        done = ~go
        total[at[done]] = own[done]
        at, k, term, m, own = at[go], k[go], term[go], m[go], own[go]
    log = _log_probability(count, mean) + np.log(total)
    return np.where(log > -745.2, np.exp(np.minimum(log, 0.0)), 0.0)


def poisson_tails_of(count: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P[X <= count], P[X >= count]); NaN where the count is no non-negative integer or the mean no positive finite number."""
    count, mean = np.asarray(count, float), np.asarray(mean, float)
    left, right = np.full(len(count), np.nan), np.full(len(count), np.nan)
    with np.errstate(all="ignore"):
        fit = np.isfinite(count) & (count >= 0) & (count == np.floor(count)) & np.isfinite(mean) & (mean > 0)
        low, high = np.flatnonzero(fit & (count <= mean)), np.flatnonzero(fit & (count > mean))
        left[low] = np.minimum(1, _tails(count[low], mean[low], False))
        below = np.zeros(len(low))
        some = count[low] > 0
        below[some] = _tails(count[low][some] - 1, mean[low][some], False)
        right[low] = np.clip(1 - below, 0, 1)
        right[high] = np.minimum(1, _tails(count[high], mean[high], True))
        left[high] = np.clip(1 - _tails(count[high] + 1, mean[high], True), 0, 1)
    return left, right


def _p_values(count: pd.Series, mean: pd.Series) -> pd.DataFrame:
    left, right = poisson_tails_of(count.to_numpy(float, na_value=np.nan), mean.to_numpy(float, na_value=np.nan))
    many, few = right < left, (right >= left) & (left < 0.5)
    value = np.where(np.isnan(left), np.nan, np.where(many, right, np.where(few, 1 - left, 0.5)))
    return pd.DataFrame({
        "kind": np.where(few, "near_one", "direct"), "value": pd.arrays.ArrowExtensionArray(pa.array(value)),
        "eps": pd.arrays.ArrowExtensionArray(pa.array(left, mask=~few))})


def p_value_of(count: Column | str, mean: Column | str) -> Column:
    """(kind, value, eps): two-sided p-value near 0 for too many collisions, near 1 for too few, 0.5 in between.

    Kind ``near_one`` also has the distance to 1 in eps, ``direct`` a null; without a p-value, value is NaN.
    """
    return F.pandas_udf(_p_values, P_VALUE)(_double(count), _double(mean))
